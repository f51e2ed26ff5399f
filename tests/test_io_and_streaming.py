import struct
import zlib

from pyspark.sql import functions as F

from ferrywork import schema
from ferrywork.operators import frames
from ferrywork.sources import io
from ferrywork.streaming import incremental


def png(path, w, h, rgb):
    raw = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "d", "page_num": 1, "text": "é"}\n\n{"doc_id": "e"}\n', encoding="utf-8")
    got = io.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema.PAGE).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == [("d", "é"), ("e", None)]
    (tmp_path / "l.json").write_text('[{"doc_id": "d"}]')
    assert io.read_json_array(spark, str(tmp_path / "l.json"), schema.PAGE).count() == 1
    (tmp_path / "o.json").write_text('{"doc_id": "d"}')
    try:
        io.read_json_array(spark, str(tmp_path / "o.json"), schema.PAGE)
        raise AssertionError
    except ValueError:
        pass


def test_pages_with_fallback(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 300 + b"\f" + b"y" * 10)
    (tmp_path / "b.pdf").write_bytes(b"short")
    got = io.extract_pages(spark, str(tmp_path), lambda b: b.decode().split("\f"), lambda b: ["second " + b.decode()]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.page_num, r.text[:6]) for r in got) == [("a.pdf", 1, "xxxxxx"), ("a.pdf", 2, "yyyyyy"), ("b.pdf", 1, "second")]


def test_append_only_what_is_new(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "out")
    assert io.append_new(df, path, ["k"]).count() == 2
    assert io.append_new(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"]).count() == 1
    assert spark.read.json(path).count() == 3


def test_images(spark, tmp_path):
    png(tmp_path / "red.png", 20, 16, (200, 10, 10))
    png(tmp_path / "mask.png", 8, 8, (10, 10, 10))
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = io.read_images(spark, str(tmp_path))
    got = {r.id.rsplit("/", 1)[1]: r for r in frames.image_statistics(images).collect()}
    assert got["red.png"].red_dominance == 190.0 and got["red.png"].quality_score == 7.04 and got["red.png"].contrast < 1e-9 and len(got["red.png"].phash) == 4 and got["bad.png"].brightness is None
    classes = {r.id.rsplit("/", 1)[1]: r.classes for r in frames.mask_classes(images).collect()}
    assert classes["mask.png"] == {"gallbladder": 1.0}
    assert {r.path.rsplit("/", 1)[1]: r.companion is not None for r in io.companion(io.list_files(spark, str(tmp_path), "*.png"), "red.png", ["none.png", "mask.png"]).collect()} == {"red.png": True}


def test_stream_resume_and_errors(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, n int").write.parquet(src)
    cache = str(tmp_path / "cache")
    stream = spark.readStream.schema("key string, n int").parquet(src)
    for _ in range(2):
        incremental.call_once(stream, cache, "key", lambda d: d.withColumn("out", F.col("n") * 10), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.key, r.out) for r in spark.read.parquet(cache).collect()) == [("a", 10), ("b", 20)]
    bad = incremental.guarded(spark.createDataFrame([("1",), ("x",), (None,)], "t string"), "t", lambda t: str(int(t) + 1))
    got = {r.t: (r.response, r.error) for r in bad.collect()}
    assert got["1"] == ("2", None) and got["x"][0] is None and "ValueError" in got["x"][1] and got[None][0] is None


def test_image_features_and_hash():
    import numpy as np

    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (3, 40, 48), dtype=np.uint8)
    f = frames.view_features(rgb)
    gray = np.floor(0.299 * rgb[0].astype(float) + 0.587 * rgb[1] + 0.114 * rgb[2] + 0.5)
    inner = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]
    assert abs(f[0] / inner.var() - 1) < 0.2 and f[1] == gray.mean() and f[7:] == (40.0, 48.0)
    ramp = np.broadcast_to(np.arange(64, dtype=np.uint8) * 4, (3, 64, 64))
    words = frames.average_hash(ramp)
    bits = "".join(f"{w & (2**64 - 1):064b}" for w in words)
    assert len(words) == 4 and bits == ("0" * 8 + "1" * 8) * 16
    assert frames.pixels(-1, -1, 0, b"") is None and frames.average_hash(np.zeros((3, 5, 7), np.uint8)) == [0, 0, 0, 0]


def test_frame_paths_configuration_and_lists(spark, tmp_path, monkeypatch):
    import json

    for name in ("a/video01_5.jpg", "a/x.jpg", "v/f_1_endo.png", "v/f_1_endo_color_mask.png", "v/f_1_endo_watershed_mask.png", "v/f_2_endo.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    root = f"file:{tmp_path}"
    files = io.list_files(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, f"{root}/a/x.jpg", "a", "q.jpg", "video01", 5), (2, "gone", "a", "x.jpg", "video01", 5), (3, "gone", "a", "no.jpg", "video01", 5), (4, "gone", None, None, None, None)], "i int, frame_path string, split string, image_filename string, video_id string, frame_id int")
    got = {r.i: (r.frame_path.rsplit("/", 1)[-1], r.frame_exists) for r in io.resolve_frames(rows, files, root).collect()}
    assert got == {1: ("x.jpg", True), 2: ("x.jpg", True), 3: ("video01_5.jpg", True), 4: ("gone", False)}
    masks = {r.source.rsplit("/", 1)[-1]: (r.has_mask, r.color_mask_path is not None) for r in io.frame_files(spark, str(tmp_path)).collect()}
    assert masks == {"f_1_endo.png": (True, True), "f_2_endo.png": (False, False)}
    monkeypatch.setenv("TOP_K", "9")
    assert io.config(spark, top_k=5, use_reranker=False, alpha=0.6) == {"top_k": 9, "use_reranker": False, "alpha": 0.6}
    io.write_json_array(spark.createDataFrame([(1, "é"), (2, None)], "a int, b string"), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == [{"a": 1, "b": "é"}, {"a": 2}]
    types = "a int, b string"
    from pyspark.sql.types import _parse_datatype_string

    assert io.read_first(spark, [str(tmp_path / "none.json"), str(tmp_path / "x.json")], _parse_datatype_string(types)).count() == 2
    models = {"vqa": {"models": [{"id": "a", "enabled": True}, {"id": "b"}]}}
    assert [m["id"] for m in io.enabled_models(models)] == ["a"] and io.enabled_models(models, "b") == [{"id": "b"}]
    assert "| a | b |" in io.markdown_report("T", {"P": spark.createDataFrame([(1, "x")], "a int, b string")}, {"n": 1})
