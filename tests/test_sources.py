import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import records as R
from lodestrata.operators import inference
from lodestrata.plans import report
from lodestrata.sources import sinks, tables
from lodestrata.sources.tables import InputError
from lodestrata.streaming import replay as stream


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_images_and_hash_cache(spark, tmp_path):
    for name, data in (("photo/a.JPG", b"1"), ("photo/b.png", b"2"), ("xray/c.tif", b"1"), ("notes.txt", b"x")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    files = tables.images(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in files.collect()) == ["photo/a.JPG", "photo/b.png", "xray/c.tif"]
    done, cache = tables.content_keys(files)
    by = {r["file_name"]: r["sha256"] for r in done.collect()}
    assert by["photo/a.JPG"] == by["xray/c.tif"] != by["photo/b.png"]
    again, _ = tables.content_keys(files, cache)
    assert {r["file_name"]: r["sha256"] for r in again.collect()} == by


def test_own_labels(spark, tmp_path):
    path = write(tmp_path / "l.csv", '﻿file_name,specimen,note\r\nx/a.jpg, s1 ,"he said ""hi"", twice"\r\nx/b.jpg,,\r\n')
    own = tables.own_labels(spark, path, "specimen")
    assert own.columns == ("file_name", "specimen", "note")
    assert [tuple(r) for r in own.rows.orderBy("file_name").collect()] == [("x/a.jpg", "s1", 'he said "hi", twice'), ("x/b.jpg", "", "")]
    for text, why in (("a,b\n1,2\n", "file_name is missing"), ("file_name,c,c\n1,2,3\n", "c stands more than once"), ("file_name,label_drop\n1,2\n", "label_drop is kept"), ("file_name,\n1,2\n", "2 has no name"), ("file_name\n1\n", "specimen")):
        with pytest.raises(InputError, match=why):
            tables.own_labels(spark, write(tmp_path / "bad.csv", text), "specimen" if why == "specimen" else "none")


def test_lists_and_sheets(spark, tmp_path):
    path = write(tmp_path / "drops.txt", "# why\n\na.jpg\tblurred\nb.jpg\na.jpg\t twice \n")
    assert {r["key"]: r["reason"] for r in tables.drop_list(spark, path).collect()} == {"a.jpg": "twice", "b.jpg": "dropped"}
    path = write(tmp_path / "sha.tsv", "sha256\treason\nabc\tx\n")
    assert [r["key"] for r in tables.drop_list(spark, path, "sha256").collect()] == ["abc"]
    path = write(tmp_path / "names.txt", "b\n#c\n a \n\nb\n")
    assert [r["name"] for r in tables.name_list(spark, path).orderBy("pos").collect()] == ["b", "a"]
    path = write(tmp_path / "s.tsv", "column\tfrom\tto\tdecision\nc\t x\ty \taccept\nc\tz\n")
    rows = tables.sheet(spark, path, ["column", "from", "to", "decision"]).orderBy("pos").collect()
    assert [(r["from"], r["to"], r["decision"]) for r in rows] == [("x", "y", "accept"), ("z", "", "")]
    with pytest.raises(InputError, match="no column"):
        tables.sheet(spark, path, ["images"])


def line(name, status="ok", **more):
    return json.dumps({"file_name": name, "status": status, **more})


def test_record_policies(spark, tmp_path):
    good = [line("a"), line("b", "skipped", reason="dark"), line("a", qa={"flags": ["x"]}, instances=[{"area": 4.0}])]
    clean = write(tmp_path / "clean.jsonl", "\n".join(good) + "\n")
    torn = write(tmp_path / "torn.jsonl", "\n".join([*good, '{"file_name": "c", "sta']))
    middle = write(tmp_path / "middle.jsonl", "\n".join([good[0], "{oops", good[1]]))
    names = lambda p, policy: sorted(r["file_name"] for r in tables.records(spark, p, policy).collect())
    assert names(clean, "strict") == ["a", "b"] and names(clean, "ok") == ["a"]
    last = tables.records(spark, clean).where("file_name = 'a'").first()
    assert last["qa"]["flags"] == ["x"] and last["instances"][0]["area"] == 4.0 and last["instances"][0]["holes_filled_px"] is None
    assert names(torn, "repair") == names(torn, "tolerant") == ["a", "b"] and names(middle, "tolerant") == ["a", "b"]
    for path, policy in ((torn, "strict"), (middle, "repair"), (middle, "ok")):
        with pytest.raises(InputError):
            tables.records(spark, path, policy)


def test_status_and_coco(spark, tmp_path):
    recs = tables.records(spark, write(tmp_path / "r.jsonl", "\n".join([line("b", width=9, height=8, instances=[{"area": 1.0}, {"area": 2.0}]), line("a", width=1, height=1, instances=[{"area": 3.0}]), line("c", "skipped")])))
    skipped = spark.createDataFrame([("c", "no_detection")], "key string, reason string")
    s = {r["file_name"]: (r["status"], r["reason"], r["n_instances"]) for r in tables.status_of(recs, skipped, "photo").collect()}
    assert s == {"photo/a": ("ok", "", 1), "photo/b": ("ok", "", 2), "photo/c": ("skipped", "no_detection", 0)}
    images, annotations, categories = sinks.coco(recs)
    assert [(r["id"], r["file_name"]) for r in images.orderBy("id").collect()] == [(1, "a"), (2, "b")]
    assert [(r["id"], r["image_id"], r["instance_index"], r["area"]) for r in annotations.orderBy("id").collect()] == [(1, 1, 0, 3.0), (2, 2, 0, 1.0), (3, 2, 1, 2.0)]
    assert categories.count() == 1
    doc = {"images": [{"id": 1, "file_name": "a", "width": 2, "height": 3}], "annotations": [{"id": 1, "image_id": 1}, {"id": 2, "image_id": 1}]}
    assert [r["n_annotations"] for r in tables.coco_images(spark, write(tmp_path / "coco.json", json.dumps(doc))).collect()] == [2]


def test_csv_round_trip_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", True, None), ('q"x, y', False, 'say "hi"')], "file_name string, ok boolean, note string")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = tables.own_labels(spark, str(tmp_path / "out")).rows.orderBy("file_name").collect()
    assert [tuple(r) for r in back] == [("a", "True", ""), ('q"x, y', "False", 'say "hi"')]
    assert [r["file_name"] for r in sinks.resume(df, df.where("ok")).collect()] == ['q"x, y']
    assert sinks.review_lines(df.where("ok"), ["file_name", "note"], ["made by hand"]) == ["# made by hand", "file_name\tnote", "a\t"]
    sinks.write_sidecar(spark, str(tmp_path / "run.json"), {"settings": {"a": 1}})
    saved = sinks.read_sidecar(spark, str(tmp_path / "run.json"))
    sinks.check_resume(saved, {"a": 1, "b": 2}, {"b": 2})
    with pytest.raises(InputError, match="a 1 -> 3"):
        sinks.check_resume(saved, {"a": 3})
    assert sinks.merged_settings({"merged": True, "base_config": {"settings": {"a": 1, "b": 1}}, "patch_config": {"settings": {"b": 2}}}) == {"a": 1, "b": 2}
    assert sinks.input_hash(df) == sinks.input_hash(df.repartition(3)) != sinks.input_hash(df.where("ok"))


def test_review_configuration():
    fix = {"setting": "margin", "turn": "up", "cost": "time"}
    cfg = {"review": {"categories": [{"name": "bleed", "text": "spills", "fixes": [fix]}, {"name": "cut_2", "text": "cut"}], "max_rate": 0.1, "caveats": ["few"]}, "domains": {"photo": {"label": "Photos"}, "xray": None}}
    review = tables.Review.of(cfg)
    assert review.labels == {"photo": "Photos", "xray": "xray"} and review.names == ["bleed", "cut_2"] and review.caveats == ("few",) and review.max_rate == 0.1
    part = lambda *cats, **more: {"review": {"categories": list(cats), "max_rate": 0.1} | more}
    one = {"name": "b", "text": "x"}
    for bad, why in (
        ({}, "review is missing"), (part(), "one to 9"), (part(one | {"name": "B"}), "lower-case"), (part({"name": "b"}), r"categories\[0\].text is missing"), (part(one, one), "different names"),
        ({"review": {"categories": [one]}}, "max_rate is missing"), (part(one, max_rate=2), "between 0 and 1"), (part(*[one | {"name": f"c{i}"} for i in range(10)]), "one to 9"), (part(one | {"fixes": [fix | {"cost": None}]}), "cost is missing"), (part("b"), "not a mapping"),
    ):
        with pytest.raises(InputError, match=why):
            tables.Review.of(bad)


NASTY = ["", " ", "\t x", "a\tb", 'say "hi"', '"', "two\nlines", "\u00a0edge\u2003", "#no comment", "it's", "a,b", "\x1cend\x1f", "é 😀"]


@pytest.mark.parametrize("sep", ["\t", ","])
def test_fields_are_read_as_python_reads_them(spark, tmp_path, sep):
    rng = random.Random(sep)
    rows = [[rng.choice(NASTY) + rng.choice(NASTY) for _ in range(3)] + [f"k{i}"] for i in range(200)]
    path = tmp_path / "t.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, delimiter=sep, lineterminator="\n").writerows([["a", "b", "c", "file_name"], *rows])
    with open(path, encoding="utf-8", newline="") as f:
        want = [tuple(x.strip() for x in r) for r in list(csv.reader(f, delimiter=sep))[1:]]
    got = tables.sheet(spark, str(path), ["a", "b", "c", "file_name"]).orderBy("pos").drop("pos") if sep == "\t" else tables.own_labels(spark, str(path)).rows
    assert [tuple(r) for r in got.collect()] == want


def test_lists_strip_all_white_space(spark, tmp_path):
    path = write(tmp_path / "n.txt", "\ufeffa.jpg\t\r\n\t\r\n\u00a0b.jpg \x0b\n")
    assert [r["name"] for r in tables.name_list(spark, path).orderBy("pos").collect()] == ["a.jpg", "b.jpg"]
    path = write(tmp_path / "d.txt", "a.jpg \twhy\x0c\r\n\t\r\nb.jpg\u2003\n")
    assert {r["key"]: r["reason"] for r in tables.drop_list(spark, path).collect()} == {"a.jpg": "why", "b.jpg": "dropped"}


def test_large_log_is_read_in_blocks(spark, tmp_path):
    """Order holds over the blocks of a file that several tasks read."""
    n = 30_000
    path = write(tmp_path / "r.jsonl", "\n".join(line(f"f{i % 500}", reason=str(i)) for i in range(n)) + "\n" + '{"torn')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert tables.numbered_lines(spark, path).rdd.getNumPartitions() > 5
        got = {r["file_name"]: int(r["reason"]) for r in tables.records(spark, path, "repair").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {f"f{i}": n - 500 + i for i in range(500)}


def test_inference(spark):
    class Fake:
        def segment(self, name, content):
            if content == b"bad":
                raise inference.Unreadable("not an image")
            return {"status": "ok", "width": len(content), "height": 1, "instances": [{"area": 1.0, "flags": ["tiny"]}]}

        def embed(self, contents):
            return [[float(len(c)), 1.0] for c in contents]

    images = spark.createDataFrame([("a", bytearray(b"xyz")), ("b", bytearray(b"bad"))], "file_name string, content binary")
    fake = Fake  # a class of this function goes to the workers by value
    got = {r["file_name"]: r for r in inference.segment(images, fake).collect()}
    assert got["a"]["status"] == "ok" and got["a"]["instances"][0]["flags"] == ["tiny"] and got["b"]["reason"] == "unreadable: not an image"
    assert got["a"].__fields__ == [f.name for f in R.RECORD.fields]
    assert sorted(r["embedding"] for r in inference.embeddings(images, fake, batch=1).collect()) == [[3.0, 1.0], [3.0, 1.0]]
    names = spark.createDataFrame([("x/a.jpg",), ("x/a.png",), ("x/b.jpg",)], "file_name string")
    assert [r["stem"] for r in inference.unique_stems(names).collect()] == ["a"]


def test_stream_replay(spark, tmp_path):
    schema = "file_name string, verdict string, line int"
    log = tmp_path / "log"
    batches = [[("a", "fix", 1), ("b", "ok", 2)], [("a", "ok", 3), ("b", None, 4)], [("b", "fix", 0), ("c", "drop", 5)]]
    store = stream.ReplayStore(spark, str(tmp_path / "state"), ["file_name"], ["line"])
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(log))
        store.start(spark.readStream.schema(schema).json(str(log)), str(tmp_path / "cp")).awaitTermination()
    got = {r["file_name"]: r["verdict"] for r in stream.decisions(store.read()).collect()}
    assert got == {"a": "ok", "c": "drop"}  # the late line of b does not bring it back
    assert {r["file_name"]: r["verdict"] for r in stream.decisions(store.read(before=1)).collect()} == {"a": "fix", "b": "ok"}
    short = stream.ReplayStore(spark, str(tmp_path / "state"), ["file_name"], ["line"], keep=1)
    short.update(spark.createDataFrame([("d", "ok", 9)], schema), 3)
    assert short._versions() == [2, 3] and stream.decisions(short.read()).count() == 3


def test_event_windows(spark):
    ev = spark.sql("select * from values (timestamp'2024-01-01 00:10:00', 1, 'x', 1.0), (timestamp'2024-01-01 00:50:00', 1, 'x', 2.0), (timestamp'2024-01-01 01:05:00', 1, 'x', 4.0) as t(ts, user_id, event_type, value)")
    assert sorted((r["n"], float(r["total"])) for r in stream.tumbling(ev).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r["n"] for r in stream.sessions_by_gap(ev).collect()) == sorted(r["n"] for r in stream.sessions(ev).collect()) == [1, 2]


def test_reports():
    stats = [{"label": "Photos <b>", "rate": 0.07, "low": 0.046, "high": 0.105, "accepted": True, "bad": 21, "judged": 300, "ok": 279, "fix": 21, "drop": 0, "population": 11693, "estimates": [819, 540, 1223]}]
    html = report.error_report(stats, [{"category": "bleed", "k": 8, "n": 300}], 0.10, ["R"], {"margin": 3}, ["One sample."])
    assert html.count("<section>") == 8 and "&lt;b&gt;" in html and "<b>" not in html and "accepted" in html
    pair = [{"label": "Photos", "n": 6, "fixed": 2, "still": 2, "both_ok": 1, "broken": 1, "p": 1.0, "rates": stats}]
    assert report.compare_report(pair, [], [], []).count("<section>") == 8
    assert report.axis(0.105) == (pytest.approx(0.12), 0.02) and report.axis(0.4) == (pytest.approx(0.4), pytest.approx(0.1)) and report.axis(0) == (1.0, 0.25) and report.fmt_p(0.0001) == "p < 0.001" and report.pct(0.0349) == "3.5 %"
    assert report.judged_by([]) == "Judged by an unknown reviewer." and report.judged_by(["b"]) == "Judged by b." and "a, b; their" in report.judged_by(["b", "a", "b"])
    assert F is not None
