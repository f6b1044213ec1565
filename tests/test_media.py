"""Images, clips, binaries, files, logs."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from hushspan.operators import binaries, images, regions, video
from hushspan.sources import config, files, usage


def box(x, y, w, h):
    return {"x": float(x), "y": float(y), "w": float(w), "h": float(h)}


def test_tile_starts(spark):
    df = spark.createDataFrame([(1200, 2048, 384), (2048, 2048, 384), (2049, 2048, 384), (15360, 2048, 2048), (40000, 2048, 384)], "t int, s int, o int")
    for r in df.select("*", regions.starts(F.col("t"), F.col("s"), F.col("o")).alias("x")).collect():
        x = r["x"]
        assert x[0] == 0 and (x == [0] or x[-1] == r["t"] - r["s"]) and all(b - a <= r["s"] - min(r["o"], r["s"] // 2) for a, b in zip(x, x[1:]))
        if r["t"] == 15360:
            assert len(x) == 14


def test_regions_merge():
    face = lambda *b: {"type": "face", "box": box(*b), "confidence": 0.9}
    assert [r["box"] for r in regions.merge_regions([face(296, 4261, 122, 122), face(323, 4319, 66, 67)])] == [box(296, 4261, 122, 125)]
    assert len(regions.merge_regions([face(0, 0, 10, 10), face(100, 0, 10, 10)])) == 2


def test_lines_merge():
    word = {"start": 0, "end": 5, "box": box(0, 0, 50, 10)}
    line = lambda t, b, w: {"text": t, "box": b, "words": w}
    same = regions.merge_lines([line("hello", box(0, 0, 50, 10), [word]), line("hello", box(0, 3, 50, 10), [word])])
    assert len(same) == 1 and same[0]["box"] == box(0, 0, 50, 13) and same[0]["words"][0]["box"] == box(0, 0, 50, 13)
    short = regions.merge_lines([line("hello", box(0, 0, 50, 10), [word]), line("hell", box(0, 3, 40, 10), [])])
    assert short[0]["text"] == "hello" and short[0]["words"] == []
    assert len(regions.merge_lines([line("MRN 88213", box(10, 0, 20, 10), []), line("other text", box(0, 0, 90, 10), [])])) == 2


def samples(spark, reads):
    rows = [(1, float(t), [{"type": "face", "box": b, "confidence": 0.5} for b in bs]) for t, bs in reads]
    return spark.createDataFrame(rows, f"clip_id long, t double, regions array<{regions.REGION}>")


def test_clips(spark):
    s = samples(spark, [(1, [box(0, 0, 1, 1)]), (2, [box(5, 0, 1, 1)])])
    f = spark.createDataFrame([(1, -1.0), (1, 1.0), (1, 1.9), (1, 9.0)], "clip_id long, t double")
    look = lambda d: [r["sample_t"] for r in d.orderBy("t").collect()]
    assert look(video.as_of(s, f)) == [1, 1, 1, 2] and look(video.as_of(s, f, fallback=False)) == [None, 1, 1, 2]
    assert look(video.verified(s, f)) == [None, 1, None, None] and look(video.verified(s, f, 1.0)) == [None, 1, 2, None]
    assert video.distinct_regions(s).count() == 2


def test_gaps(spark):
    reads = [(0.25 * k, [box(0, 0, 10, 10)] if k in (0, 6) else []) for k in range(7)]
    n = lambda window: sum(len(r["regions"]) for r in video.fill_gaps(samples(spark, reads), window).collect())
    assert n(1) == 2 and n(2) == 7
    moved = video.fill_gaps(samples(spark, [(0, [box(0, 0, 10, 10)]), (1, []), (2, [box(1, 0, 10, 10)])]), 2).where("t = 1").first()
    assert [r["box"].asDict() for r in moved["regions"]] == [box(0, 0, 11, 10)]
    none = spark.createDataFrame([], "clip_id long, t double, before_t double, after_t double")
    assert sum(len(r["regions"]) for r in video.fill_gaps(samples(spark, reads), 2, none).collect()) == 2


def test_painting():
    white = b"\xff" * 40 * 30 * 4
    for style in images.STYLES:
        assert len(images.paint(40, 30, white, [box(5, 5, 8, 6)], style)) == len(white)
    assert images.paint(40, 30, white, [box(0, 0, 40, 30)]) == b"\0\0\0\xff" * 1200
    assert images.paint(40, 30, white, [box(0, 0, 40, 30) | {"enabled": False}]) == white
    data = images.png(40, 30, white)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(data[41 : data.index(b"IEND") - 8])[1:5] == b"\xff\xff\xff\xff"


def test_stamps():
    region = {"x": 4.0, "y": 4.0, "w": 60.0, "h": 20.0, "token": "NAME_A1"}
    white = b"\xff" * (80 * 30 * 4)
    plain, stamped = images.paint(80, 30, white, [region]), images.paint(80, 30, white, [region], stamped=True)
    assert plain != stamped and stamped == images.paint(80, 30, white, [region], stamped=True)
    pixels = {stamped[i : i + 4] for i in range(0, len(stamped), 4)}
    assert pixels == {b"\xff\xff\xff\xff", b"\0\0\0\xff"}
    # a box too small for its token, and styles that show what lies below, stay as they are
    small = region | {"w": 8.0}
    assert images.paint(80, 30, white, [small], stamped=True) == images.paint(80, 30, white, [small])
    assert images.paint(80, 30, white, [region], "blur", stamped=True) == images.paint(80, 30, white, [region], "blur")


def test_image_pipeline(spark):
    from hushspan.plans.images import ImagePipeline

    schema = f"image_id long, idx int, text string, x double, y double, w double, h double, words {regions.WORDS}, extra string"
    word = lambda a, b: {"start": a, "end": b, "box": box(a * 2, 0, (b - a) * 2, 8)}
    lines = [(1, 0, "to ann@example.org now", 0.0, 0.0, 44.0, 8.0, [word(0, 2), word(3, 18), word(19, 22)], "e"), (1, 1, None, 0.0, 10.0, 5.0, 8.0, None, "e"), (1, 2, "SSN 123-45-6789", 0.0, 20.0, 30.0, 8.0, None, "e")]
    lines += [(2, 0, "", 0.0, 0.0, 1.0, 1.0, None, "e"), (3, 0, "bob@example.org", 0.0, 0.0, 30.0, 8.0, None, "e"), (6, 0, "no image", 0.0, 0.0, 9.0, 9.0, None, "e")]
    read = spark.createDataFrame(lines, schema)
    white = bytearray(b"\xff" * (50 * 30 * 4))
    shown = spark.createDataFrame([(1, 50, 30, white), (2, 50, 30, white), (3, 50, 30, white[:-1]), (4, 50, 30, white), (None, 50, 30, white)], "image_id long, width int, height int, rgba binary")
    face = spark.createDataFrame([(2, "face", 0.9, 5.0, 5.0, 10.0, 10.0), (2, "face", 0.8, 6.0, 6.0, 9.0, 9.0), (4, "face", 0.9, 1.0, 1.0, 2.0, 2.0)], "image_id long, type string, confidence double, x double, y double, w double, h double")
    own = ImagePipeline()
    found = {r["image_id"]: {x["type"]: x for x in r["regions"]} for r in own.regions(read, face).collect()}
    assert set(found) == {1, 2, 3, 6} and found[6] == {}
    at = lambda r: (r["x"], r["y"], r["w"], r["h"])
    assert at(found[1]["email"]) == (6.0, 0.0, 30.0, 8.0) and at(found[1]["ssn"]) == (0.0, 20.0, 30.0, 8.0)
    assert found[1]["email"]["enabled"] and found[1]["email"]["token"] and "value" not in found[1]["email"].asDict()
    assert len(found[2]) == 1 and found[2]["face"]["source"] == "face" and found[2]["face"]["token"] is None
    out = {r["image_id"]: r for r in own.redact(shown, read, face, mode="pseudonymise", key=b"k" * 32).collect()}
    painted = images.png(50, 30, images.paint(50, 30, bytes(white), [x.asDict() for x in out[1]["regions"]], stamped=True))
    assert bytes(out[1]["png"]) == painted != images.png(50, 30, bytes(white))
    # unread images, odd pixels and null ids come out empty instead of unpainted
    assert out[2]["png"] is not None and [out[i]["png"] for i in (3, 4, None)] == [None] * 3
    assert own.redact(shown.where("false"), read).count() == 0 and own.regions(read.where("false")).count() == 0
    with pytest.raises(ValueError):
        own.redact(shown.withColumn("png", F.lit(1)), read)


def test_a_span_over_lines(spark):
    from hushspan.plans.images import region_rows

    line = lambda text, y: {"text": text, "x": 0.0, "y": y, "w": 9.0, "h": 5.0, "words": []}
    lines = [line("abc", 0.0), line("", 10.0), line("defg", 20.0)]
    s = {"type": "name", "confidence": 0.6, "source": "regex", "disposition": "flag", "enabled": False}
    r = region_rows([s | {"start": 1, "end": 7}, s | {"start": 8, "end": 9}], {1: "T"}, lines)
    assert [(x["y"], x["h"], x["token"], x["enabled"]) for x in r] == [(0.0, 25.0, "T", False), (20.0, 5.0, None, False)]
    assert region_rows([s | {"start": 3, "end": 4}], {}, lines) == []  # a newline has no box


def test_thumbnails(spark):
    df = spark.createDataFrame([(4000, 2000), (600, 3000), (4000, 3), (100, 50)], "w int, h int")
    got = [tuple(r[0]) for r in df.select(images.thumbnail_size(F.col("w"), F.col("h"))).collect()]
    assert got == [(512, 256), (102, 512), (512, 1), (100, 50)]


def element(tag, kind, value, length=None):
    head = (tag >> 16).to_bytes(2, "little") + (tag & 0xFFFF).to_bytes(2, "little") + kind
    if kind in binaries.LONG_KINDS:
        return head + b"\0\0" + (len(value) if length is None else length).to_bytes(4, "little") + value
    return head + len(value).to_bytes(2, "little") + value


def scan_of(*parts, syntax=b"1.2.840.10008.1.2.1\0"):
    return bytes(128) + b"DICM" + element(0x00020010, b"UI", syntax) + b"".join(parts)


def test_dicom():
    open_sequence = element(0x00081140, b"SQ", b"", 0xFFFFFFFF) + b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + element(0x00100020, b"LO", b"inner!") + b"\xfe\xff\x0d\xe0\0\0\0\0" + b"\xfe\xff\xdd\xe0\0\0\0\0"
    data = scan_of(open_sequence, element(0x00100010, b"PN", b"DOE^JOHN"), element(0x00180015, b"CS", b"CHEST "))
    out, _ = binaries.dicom(data)
    assert len(out) == len(data) and b"DOE" not in out and b"CHEST" in out and b"inner!" in out
    assert binaries.dicom(data[:-3]) is None and binaries.dicom(b"x" * 300) is None
    assert binaries.dicom(scan_of(element(0x00100010, b"PN", b"DOE^JOHN"), syntax=b"1.2.840.10008.1.2.2\0")) is None
    assert binaries.dicom(scan_of(open_sequence[:-8], element(0x00100010, b"PN", b"DOE^JOHN"))) is None


def test_deidentify(spark):
    edf = b"0       " + b"P" * 160 + b"z" * 100
    df = spark.createDataFrame([("a.edf", bytearray(edf)), ("b", bytearray(edf)), ("c.edf", bytearray(b"0 short")), ("d.txt", bytearray(b"x")), ("e.dcm", bytearray(b"x"))], "path string, content binary")
    got = {r["path"]: r["data"] for r in binaries.deidentify(df).collect()}
    assert bytes(got["a.edf"]) == edf[:8] + b" " * 160 + edf[168:] == bytes(got["b"]) and got["c.edf"] is got["d.txt"] is got["e.dcm"] is None


def test_files(spark, tmp_path):
    for name in ("a.txt", "sub/b.md", ".hidden.txt", "x.app/in.txt", "c.docx", "noext", "out/d.txt", "out/e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("héllo")
    rows = {r["path"].removeprefix(str(tmp_path)): r["reason"] for r in files.scan(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert rows["/a.txt"] is None and rows["/sub/b.md"] is None and "/.hidden.txt" not in rows and "/x.app/in.txt" not in rows
    assert rows["/out"] == "2 files already in this folder were not looked at" and "no file extension" in rows["/noext"] and "rich text" in rows["/c.docx"]
    with pytest.raises(NotADirectoryError):
        files.scan(spark, str(tmp_path / "none"))
    assert files.read_text(spark, str(tmp_path / "sub")).first()["text"] == "héllo"
    (tmp_path / "sub/bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8|MALFORMED"):
        files.read_text(spark, str(tmp_path / "sub")).collect()
    assert files.rich_text("x.rtf", rb"{\rtf1\ansi Hello \b bold\b0\par caf\'e9}") == "Hello bold\ncafé"


def test_html(spark):
    df = spark.createDataFrame([("<p>A &amp; <b>B</b></p><script>x@y.org</script><!-- z -->C",)], "h string")
    assert df.select(files.html_text(F.col("h"))).first()[0] == "A & B\nC"


def test_routes(spark):
    df = spark.createDataFrame([(0, "v", True, False), (1, "f", False, False), (2, "d", False, True)], "ord int, url string, is_video boolean, is_folder boolean")
    assert [r["route"] for r in files.route(df, 5).orderBy("ord").collect()] == ["video", "suppressed", "folder"]


def test_rules_of_users(tmp_path):
    rule = {"id": "1", "name": "n", "pattern": "p"}
    path = str(tmp_path / "rules.json")
    assert config.load_rules(path) == config.Rules()
    config.save_rules(path, [rule])
    assert config.load_rules(path).rules[0]["name"] == "n"
    assert config.parse_rules(json.dumps({"version": 1, "rules": [rule, {"bad": 1}]})).total == 2
    assert config.parse_rules("{").corrupt and config.parse_rules(json.dumps({"version": 2, "rules": []})).corrupt
    with pytest.raises(ValueError):
        config.import_rules(json.dumps({"rules": [rule] * 2001}))
    with pytest.raises(ValueError):
        config.guard_output(path, path)


def test_log(spark, tmp_path):
    now = F.lit("2023-11-14 22:13:20").cast("timestamp")
    log = spark.range(2).select(F.col("id").cast("string").alias("id"), (now - F.make_dt_interval(F.when(F.col("id") == 0, 100).otherwise(1))).alias("ts"), F.lit("redact").alias("mode"), F.lit("text").alias("command"), F.create_map(F.lit("ssn"), F.lit(2).cast("long")).alias("entity_counts"))
    assert not usage.append(log, str(tmp_path / "log"))
    assert usage.append(log, str(tmp_path / "log"), enabled=True)
    (tmp_path / "log/bad.json").write_text('{"id": "x", "command": "unknown"}\nnot json\n')
    back = usage.read_log(spark, str(tmp_path / "log"))
    assert back.count() == 2 and [r["id"] for r in usage.retained(back, 90, now).collect()] == ["1"]
    assert usage.by_type(back).first()["n"] == 4


def test_small_things(spark, tmp_path):
    assert config.load_prompt(None) == config.PROMPT and config.load_prompt(str(tmp_path / "none"))["categories"]
    (tmp_path / "p.json").write_text('{"template": "{categories}: {text}"}')
    assert config.load_prompt(str(tmp_path / "p.json"))["template"] == "{categories}: {text}"
    key, kept = config.load_key(str(tmp_path / "key"))
    assert kept and config.load_key(str(tmp_path / "key")) == (key, True) and not config.load_key(str(tmp_path / "no/key"))[1]
    (tmp_path / "old").mkdir()
    (tmp_path / "old/a").write_text("1")
    assert usage.adopt(str(tmp_path / "old"), str(tmp_path / "new"), ("a", "b")) == ([], []) and usage.adopt(str(tmp_path / "old"), str(tmp_path / "new"), ("a",)) == ([], ["a"])
    w, h, pixels = images.shrink(1000, 500, b"\xff" * 2_000_000)
    assert (w, h) == (512, 256) and pixels == b"\xff" * (512 * 256 * 4)
    df = spark.createDataFrame([("a.docx", "x\r\né")], "p string, t string")
    from hushspan.functions.spans import grapheme_offset

    row = df.select(config.document_type(F.col("p")), config.render_prompt("{categories}|{text}", ["A", "B"], F.col("t")), grapheme_offset(F.col("t"), F.lit(3)), regions.pixel_box(F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("w"), F.lit(0.3).alias("h")), F.lit(100), F.lit(10))).first()
    assert row[0] == "docx" and row[1] == "A, B|x\r\né" and row[2] == 2 and row[3]["y"] == pytest.approx(5)
