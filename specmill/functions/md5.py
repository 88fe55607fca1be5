"""MD5 that can be stopped and taken up again, so that several tasks, one after the other, hash one long file.

A state is OpenSSL's public ``MD5_CTX``: A to D, the count of bits, the bytes of an unfinished block and their number.
``hashlib`` keeps its state to itself, so the library behind it is called; without one, Python takes the same steps, slowly.
"""

from __future__ import annotations

import ctypes
import math
import struct
import sys

_LAYOUT = "=4IQ64sI"
_MASK = 0xFFFFFFFF
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4

START = struct.pack(_LAYOUT, 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0, b"", 0)


def _library():
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.MD5_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        return lib if sys.byteorder == "little" else None
    except (ImportError, AttributeError, OSError):
        return None


_LIBRARY = _library()


def _block(words: tuple, block: bytes) -> tuple:
    x = struct.unpack("<16I", block)
    a, b, c, d = words
    for i in range(64):
        if i < 16:
            f, k = b & c | ~b & d, i
        elif i < 32:
            f, k = d & b | ~d & c, 5 * i + 1
        elif i < 48:
            f, k = b ^ c ^ d, 3 * i + 5
        else:
            f, k = c ^ (b | ~d), 7 * i
        f = (a + f + _SINES[i] + x[k % 16]) & _MASK
        a, d, c, b = d, c, b, (b + (f << _TURNS[i] | f >> 32 - _TURNS[i])) & _MASK
    return tuple((p + q) & _MASK for p, q in zip(words, (a, b, c, d)))


def _update(state: bytes, data: bytes) -> bytes:
    *words, bits, rest, n = struct.unpack(_LAYOUT, state)
    words, todo = tuple(words), rest[:n] + data
    whole = len(todo) // 64 * 64
    for i in range(0, whole, 64):
        words = _block(words, todo[i:i + 64])
    return struct.pack(_LAYOUT, *words, bits + 8 * len(data), todo[whole:], len(todo) - whole)


def update(state: bytes, data: bytes) -> bytes:
    """The state after ``data``."""
    if _LIBRARY is None:
        return _update(state, data)
    held = ctypes.create_string_buffer(state, len(state))
    _LIBRARY.MD5_Update(held, data, len(data))
    return held.raw


def n_bytes(state: bytes) -> int:
    """How many bytes a state has taken in."""
    return struct.unpack(_LAYOUT, state)[4] // 8


def hexdigest(state: bytes) -> str:
    n = n_bytes(state)
    end = _update(state, b"\x80" + bytes((55 - n) % 64) + struct.pack("<Q", 8 * n))
    return struct.pack("<4I", *struct.unpack(_LAYOUT, end)[:4]).hex()
