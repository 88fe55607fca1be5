import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from specmill import schemas
from specmill.functions import md5
from specmill.operators import dimensions as D
from specmill.operators import ledger as L
from specmill.sources import readers, store, writers
from specmill.sources.adapter import Tables
from specmill.streaming import jobs


def test_read_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"part_number": "P1", "bom_items": [{"item_no": 1, "part_number": "X", "qty": 2}], "standards": ["S"],
                                                  "final_approval": [{"step_no": "1", "name_en": "OK"}], "packaging_notes": {"en": "BAG", "he": ""}}))
    (tmp_path / "b.json").write_text(json.dumps({"part_number": "P2", "final_approval": "", "packaging_notes": "as text"}))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "_runtime_settings.json").write_text(json.dumps({"part_number": "no"}))
    r = {x.part_number: x for x in readers.read_records(spark, str(tmp_path)).collect()}
    assert set(r) == {"P1", "P2"} and readers.read_records(spark, str(tmp_path)).count() == 2
    assert r["P1"].bom_items[0].item_no == "1" and r["P1"].final_approval[0].name_en == "OK" and r["P1"].packaging_notes.en == "BAG"
    assert r["P2"].packaging_notes.en == "as text" and r["P1"].source_path.endswith("a.json")


def test_ledger_round_trip(spark, tmp_path):
    p = str(tmp_path / "h")
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a", "single", 0.25, True), ("2024-01-02 10:00:00", "b", None, 0.01, False)],
                                 "timestamp string, filename string, mode string, cost_usd double, cache_hit boolean").select(
        F.to_timestamp("timestamp").alias("timestamp"), "filename", "mode", F.lit(None).cast("string").alias("part_number"), F.lit(None).cast("int").alias("drawing_count"),
        F.lit(None).cast("int").alias("warning_count"), F.lit(None).cast("string").alias("review_status"), "cost_usd", "cache_hit", F.lit(None).cast("string").alias("json_path"))
    writers.append_ledger(writers.history_rows(rows), p)
    (tmp_path / "h" / "zz.json").write_text("not json\n")
    got = readers.read_ledger(spark, p, schemas.HISTORY_DDL, limit=10)
    assert [r.filename for r in got.collect()] == ["b", "a"] and got.count() == 2
    assert [r.filename for r in readers.read_ledger(spark, p, schemas.HISTORY_DDL, limit=1, mode="single").collect()] == ["a"]
    s = {(r.kind, r.value): r for r in L.history_summary(got).collect()}
    assert float(s[("total", "")].total_cost_usd) == 0.26 and s[("mode", "unknown")]["count"] == 1 and s[("review_status", "pending")]["count"] == 2
    assert float(s[("total", "")].cache_hit_rate) == 0.5
    assert L.history_summary(got.where("1 = 0")).count() == 0


def _dims_json(**over):
    base = {"cage_to_customer": {"1A11A": "N Ltd."}, "customer_to_default_cage": {"N Ltd.": "1A11A"}, "customer_aliases": {"NORTH": "N Ltd."},
            "pn_prefix_to_customer": {"NP": "N Ltd."}, "customer_internal_spec_patterns": {"N Ltd.": ["^I-\\d+"]}}
    return {**base, **over}


def test_dimensions(spark, tmp_path):
    f = tmp_path / "d.json"
    f.write_text(json.dumps(_dims_json()))
    dims = readers.read_dimensions(spark, str(f))
    assert dims["alias"].first().customer == "N Ltd."
    for i, bad in enumerate([_dims_json(cage_to_customer={"1!": "N"}), _dims_json(customer_aliases={"A": " "}), _dims_json(customer_internal_spec_patterns={"N": ["(("]})]):
        g = tmp_path / f"bad{i}.json"
        g.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            readers.read_dimensions(spark, str(g))
    d = _dims_json()
    del d["pn_prefix_to_customer"]
    (tmp_path / "m.json").write_text(json.dumps(d))
    with pytest.raises(KeyError):
        readers.read_dimensions(spark, str(tmp_path / "m.json"))
    ch = spark.createDataFrame([("upsert", "M Ltd.", "N Ltd.", ["2b22b"], "2b22b", ["m"], [], [])],
                               "op string, name string, original_name string, cage_codes array<string>, default_cage string, aliases array<string>, pn_prefixes array<string>, spec_patterns array<string>")
    merged = D.merge_dimensions(dims, ch)
    r = D.dimension_rollup(merged).collect()
    assert [(x.customer, x.cage, x.default_cage, x.alias, x.pn_prefix) for x in r] == [("M Ltd.", "2B22B", "2B22B", "M", "")]
    # a change that leaves invalid rows, or a pattern that does not compile, is refused; a valid one is kept
    change = lambda cage, pattern: spark.createDataFrame([("upsert", "M Ltd.", "", [cage], cage, ["m"], [], [pattern])], ch.schema)
    kept = D.update_dimensions(dims, change("3C33C", "^M[0-9]+"), store.materialise)
    assert {r.cage for r in kept["cage"].where("customer = 'M Ltd.'").collect()} == {"3C33C"}
    for cage, pattern in (("TOO-LONG-CAGE", "^M"), ("3C33C", "([")):
        with pytest.raises(ValueError):
            D.update_dimensions(dims, change(cage, pattern), store.materialise)


def test_catalog_and_manifest(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b,c,d,e,f,g,h\nms.1,ZINC,,5 mic,,,,zinc\nms.2,nan,X,,,,,n\n")
    c = readers.read_catalog(spark, str(tmp_path / "c.csv")).orderBy("ordinal").collect()
    assert [(x.master_id, x.desc, x.standard) for x in c] == [("ms.1", "ZINC", ""), ("ms.2", "", "X")]
    d = tmp_path / "files"
    d.mkdir()
    (d / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (d / "b.pdf").write_bytes(b"PK..zip")
    (d / "c.PNG").write_bytes(b"png")
    (d / "big.pdf").write_bytes(b"%PDF-" + b"x" * 200)
    m = {r.source_filename: (r.route, r.rejected) for r in readers.file_manifest(spark, str(d), 100).collect()}
    assert m == {"a.pdf": ("pdf", ""), "b.pdf": ("pdf", "bad_magic"), "c.PNG": ("image", ""), "big.pdf": ("pdf", "too_large")}


def test_manifest_of_long_files(spark, tmp_path):
    r = random.Random(5)
    bom, body = b"\xef\xbb\xbf", r.randbytes(20000)
    made = {"a b%20.pdf": b"%PDF-" + body, "bad.pdf": b"P\n\nK" + body, "end.png": body + b"\n", "bom.bin": bom + body, "bom_end.bin": bom + bom + body + b"\n",
            "ends.bin": b"\n" * 20000, "cr.bin": b"a\r\n\r" * 5000, "no_end.bin": bytes(20000), "edge.bin": body[:8192], "edge1.bin": body[:8193], "short.pdf": b"%PDF"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    # no row may hold more than 8192 bytes of a file, as none can hold more than 2 GB
    confs = {"spark.sql.sources.binaryFile.maxLength": "8192", "spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = readers.file_manifest(spark, str(tmp_path), 20005, whole_bytes=8192).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {x.source_filename: (x.length, x.fingerprint, x.magic) for x in got} == {k: (len(v), hashlib.md5(v).hexdigest(), v[:5]) for k, v in made.items()}
    assert len(got) == len(made)
    assert {x.source_filename: x.rejected for x in got if x.rejected} == {"bom_end.bin": "too_large", "bad.pdf": "bad_magic", "short.pdf": "bad_magic"}


def test_md5_taken_up_again():
    r = random.Random(6)
    for step in (md5.update, md5._update):
        for n in (0, 55, 56, 63, 64, 65, 120, 1000):
            data, state, at = r.randbytes(n), md5.START, 0
            while at < n:
                k = r.randint(1, 150)
                state, at = step(state, data[at:at + k]), at + k
            assert (md5.n_bytes(state), md5.hexdigest(state)) == (n, hashlib.md5(data).hexdigest())


def test_export_and_writers(spark, records, tmp_path):
    df = records({"part_number": "P", "standards": ["A,B"]})
    writers.write_records(df.drop("_user_edits"), str(tmp_path / "r"), relationships=df.select("batch_id", "part_number"))
    assert spark.read.json(str(tmp_path / "r" / "drawings")).first().part_number == "P"
    assert "_saved_at" in spark.read.json(str(tmp_path / "r" / "relationships")).columns
    writers.export_flagged_csv(spark.createDataFrame([("r0", "A,B")], "record_id string, value string"), df, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).first().flagged_standard == "A;B"
    writers.write_table_set({"tree": df.select("record_id"), "bom": df.select("record_id")}, str(tmp_path / "x"), single=True)
    assert (tmp_path / "x" / "bom").exists() and not (tmp_path / "x" / "tree").exists()


def test_table_sets_are_committed_whole(spark, tmp_path):
    ids = lambda n: spark.range(n)
    folder = str(tmp_path / "x")
    tables = {"bom": ids(3), "tree": ids(0), "image_tree": ids(2)}
    for _ in range(2):
        writers.commit_table_set(tables, folder, "a")
    writers.commit_table_set(tables, folder, "b", single=True)
    bad = ids(2).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        writers.commit_table_set({"bom": ids(1), "tree": bad}, folder, "c")
    assert {tuple(r) for r in writers.committed_tables(spark, folder).select("save_id", "table_name", "n_rows").collect()} == {
        ("a", "bom", 3), ("a", "tree", 0), ("a", "image_tree", 2), ("b", "bom", 3)}
    assert {k: v.count() for k, v in writers.read_table_set(spark, folder, "a").items()} == {"bom": 3, "tree": 0, "image_tree": 2}
    with pytest.raises(ValueError):
        writers.read_table_set(spark, folder, "c")


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "stored")
    src.mkdir()
    (src / "1.json").write_text('{"k":"a","v":1}\n{"k":"a","v":2}\n{"k":"b","v":3}\n')
    run = lambda: jobs.new_records(spark.readStream.schema("k string, v int").json(str(src)), out, str(tmp_path / "cp"), ["k"]).awaitTermination()
    run()
    (src / "2.json").write_text('{"k":"b","v":4}\n{"k":"c","v":5}\n')
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]

    d = tmp_path / "dr"
    d.mkdir()
    stream = lambda: spark.readStream.schema("batch_id string, failed boolean, cost_usd decimal(18,6)").json(str(d))
    for i, body in enumerate(['{"batch_id":"x","failed":false,"cost_usd":1.5}\n', '{"batch_id":"x","failed":true,"cost_usd":9}\n{"batch_id":"y","failed":false,"cost_usd":2}\n']):
        (d / f"{i}.json").write_text(body)
        jobs.upsert_to_table(jobs.batch_outcome(stream()), str(tmp_path / "o"), str(tmp_path / "ocp")).awaitTermination()
    got = {r.batch_id: (r.total, r.succeeded, float(r.cost_usd)) for r in jobs.latest(spark, str(tmp_path / "o"), ["batch_id"]).collect()}
    assert got == {"x": (2, 1, 1.5), "y": (1, 1, 2.0)}


def _rows_of(spark, path):
    return sorted((r.k or "", r.v, r.w) for r in spark.read.parquet(path).collect())


def test_new_records_replayed_and_bounded(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "stored"), tmp_path / "cp"
    src.mkdir()
    job = lambda df: df.withColumn("k", F.upper("k")).withColumn("w", F.col("v") * 10)  # noqa: E731  changes the key, too
    run = lambda: jobs.new_records(spark.readStream.schema("k string, v int").json(str(src)), out, str(cp), ["k"], job, F.col("v"), 16).awaitTermination()
    (src / "1.json").write_text('{"k":"a","v":2}\n{"k":"a","v":1}\n{"v":7}\n{"v":6}\n')
    run()
    (src / "2.json").write_text('{"k":"a","v":0}\n{"k":"b","v":4}\n{"v":1}\n')
    run()
    want = [("", 6, 60), ("A", 1, 10), ("B", 4, 40)]
    assert _rows_of(spark, out) == want
    (cp / "commits" / "1").unlink()  # as if the second micro-batch had failed after it wrote
    for crc in (cp / "commits").glob(".1*"):
        crc.unlink()
    run()
    assert _rows_of(spark, out) == want
    touched = [r[0] for r in spark.createDataFrame([("b",)], "k string").select(jobs.key_bucket(["k"], 16)).collect()]
    known = jobs.seen_keys(spark, out, 9, touched)
    files = [r[0] for r in known.select(F.input_file_name()).distinct().collect()]
    assert known.columns == ["k"] and files and all(f"bucket={touched[0]}/" in f for f in files)


def test_running_daily_costs_with_late_rows(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "o"), str(tmp_path / "cp")
    src.mkdir()
    row = lambda t, cost, mode="single": json.dumps({"timestamp": t, "mode": mode, "cost_usd": cost}) + "\n"
    batches = [row("2024-01-01 10:00:00", 1) + row("2024-01-01 11:00:00", 2, None), row("2024-01-02 10:00:00", 4) + row("2024-01-01 23:00:00", 8),
               row("2024-01-05 10:00:00", 16), row("2024-01-01 01:00:00", 32) + row("2024-01-05 11:00:00", 64)]
    for i, body in enumerate(batches):
        (src / f"{i}.json").write_text(body)
        stream = spark.readStream.schema("timestamp timestamp, mode string, cost_usd double").json(str(src))
        jobs.upsert_to_table(jobs.running_daily_costs(stream), out, cp).awaitTermination()
        if i == 1:  # nothing is final yet, and everything is counted
            got = jobs.latest_daily_costs(spark, out).collect()
            assert sum(r.cost_usd for r in got) == 15 and not any(r.final for r in got)
    got = {(str(r.day), r.mode): (r.cost_usd, r["count"], r.final) for r in jobs.latest_daily_costs(spark, out).collect()}
    assert got == {("2024-01-01", "single"): (9.0, 2, True), ("2024-01-01", "unknown"): (2.0, 1, True), ("2024-01-02", "single"): (4.0, 1, True),
                   ("2024-01-05", "single"): (80.0, 2, False)}  # the row of 32 came after its day was final


def test_shared_folder_comes_from_session(spark):
    assert store.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_saves_run_twice_add_nothing(spark, records, tmp_path):
    df = records({"part_number": "P", "standards": ["A,B"], "material": ""}, {"part_number": "Q\n\"x\"", "machining_processes": [("1", "TURN", "", "d")]}).drop("_user_edits")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    for save in ("one", "two", "two", "one"):
        writers.write_records(df, str(tmp_path / "r"), save_id=save)
        writers.append_ledger(df.select("record_id", "part_number"), str(tmp_path / "l"), save_id=save)
    got = readers.read_saved(spark, str(tmp_path / "r"), ddl).where("save_id = 'one'").select(df.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert readers.read_saved(spark, str(tmp_path / "r"), ddl).count() == 4
    lines = readers.read_ledger(spark, str(tmp_path / "l"), "record_id string, part_number string", order="record_id")
    assert [r.record_id for r in lines.collect()] == ["r1", "r1", "r0", "r0"]


def test_rows_of_a_file_read_in_blocks_keep_its_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b,c,d,e,f,g,h\n" + "".join(f"ms.{i},x,,,,,,n\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = [r.master_id for r in readers.read_catalog(spark, str(tmp_path / "c.csv")).orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"ms.{i}" for i in range(500)]


def test_records_of_one_file_are_dealt_out_before_they_are_wide(spark, monkeypatch):
    from specmill.plans import other_checks

    class Seen(Exception):
        pass

    def look(records, *args, **kwargs):
        assert "Repartition 4, true" in records._jdf.queryExecution().analyzed().toString()
        raise Seen

    monkeypatch.setattr(other_checks.jobs, "new_records", look)
    with pytest.raises(Seen):
        other_checks.x1(spark, "/root/testdata/sf0.001")


def test_records_are_dealt_out_before_they_grow(spark, tmp_path):
    """A small file of parts is one task; the records made of it are not, even where filters on their texts are pushed down."""
    spark.range(1, 41).selectExpr("id AS p_partkey", "'x' AS p_name", "'t' AS p_type", "'b' AS p_brand", "CAST(1 AS INT) AS p_size",
                                  "CAST(1 AS DECIMAL(15,2)) AS p_retailprice").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    t = Tables(spark, str(tmp_path))
    spread = t.records().select(F.explode("standards").alias("s"), F.spark_partition_id().alias("p"))
    assert spread.select("p").distinct().count() > 1 and t.records().count() == 40
    assert {r.record_id for r in t.second_run().collect()} == {f"R{k:010d}" for k in range(1, 41)}


def test_recurring_descriptions_are_collapsed_once(monkeypatch):
    import pandas as pd

    from specmill.operators import standardise as N

    seen, real = [], N.collapse_repeats
    monkeypatch.setattr(N, "collapse_repeats", lambda t: seen.append(t) or real(t))
    got = list(N._collapse_all.func(iter([pd.Series([["A A A", "B"], None, [], ["A A A", None]])])))[0]
    assert got.tolist() == [["A", "B"], None, [], ["A", ""]] and sorted(seen, key=str) == ["A A A", "B", None]


def test_recurring_packing_notes_are_compared_once(monkeypatch):
    import pandas as pd

    from specmill.operators import rules as V

    seen, real = [], V.SequenceMatcher
    monkeypatch.setattr(V, "SequenceMatcher", lambda a, s, t: seen.append(s) or real(a, s, t))
    got = list(V._best_template_ratio.func(iter([pd.Series([V._TEMPLATES[0], None, "QWZX", V._TEMPLATES[0]])])))[0]
    assert got[0] == got[3] == 1.0 and pd.isna(got[1]) and len(seen) == 2 * len(V._TEMPLATES)
