import random

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import edits, names
from inkgauge.functions import text as tx


def one(spark, column, *values):
    """``column`` of f(a, b, ...) over one row of values."""
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, expected",
    [("ก่ิ", "กิ่"), ("กิ่", "กิ่"), ("กุ้", "กุ้"), ("ประกาศ", "ประกาศ"), ("กํา", "กำ"), ("ก่่", "ก่"), ("ม ิ ต ิ ด ้ า น", "มิติด้าน"), ("“ก”–¹⁰", '"ก"-10')],
)
def test_normal_form(spark, given, expected):
    assert one(spark, tx.normalize, given) == expected
    again = one(spark, tx.normalize, expected)
    assert again == expected


def test_spaces_digits_and_classes(spark):
    assert one(spark, lambda c: tx.normalize(c, keep_spaces=True), " ก  ข   ค ") == "ก ข ค"
    assert one(spark, tx.thai_to_arabic_digits, "๒๕๖๙ ๐") == "2569 0"
    found = [one(spark, tx.classify_char, c) for c in "ก่า๕5Aฯ é"]
    assert found == ["thai_consonant", "thai_vowel_mark", "thai_vowel_mark", "thai_digit", "arabic_digit", "latin", "punct_symbol", "other", "other"]
    counted = dict(zip(tx.CLASSES, spark.createDataFrame([("ก่า๕5Aฯ é",)], "t string").select(*[c.alias(str(k)) for k, c in enumerate(tx.class_counts(F.col("t")))]).first()))
    assert counted == {k: found.count(k) for k in tx.CLASSES}


@pytest.mark.parametrize(
    "given, expected",
    [("<b>ก</b>", "ก"), ("|---|---|", ""), ("** (ก)", "** (ก)"), ("**x** y", "x y"), ("#๑๒๓", "#๑๒๓"), ("## ๑๒๓", "๑๒๓"), ("| ก | ข |", "ก ข"), ("", "")],
)
def test_strip_markdown(spark, given, expected):
    assert one(spark, tx.strip_markdown, given) == expected


def test_truth_repair_and_defects(spark):
    assert one(spark, tx.needs_sara_repair, "ส ำนักงำน") is True
    assert one(spark, tx.needs_sara_repair, "สำนักงาน") is False
    assert one(spark, tx.repair_sara, "ส ำนักงำนคณะกรรมกำรกฤษฎีกำ") == "สำนักงานคณะกรรมการกฤษฎีกา"
    assert one(spark, tx.join_split_sara_am, "อาศัยอ านาจตามความ") == "อาศัยอำนาจตามความ"
    assert one(spark, tx.join_split_sara_am, "๙ าก") == "๙ าก"
    labels = lambda s: [d["label"] for d in one(spark, tx.truth_defects, s)]
    assert labels("ก ้ข") == ["detached mark"] and labels("้ก") == ["line starts with a mark"] and labels("ก้้") == ["stacked tones"] and labels("สะอาด") == []
    assert one(spark, tx.broken_glyph_rate, "abc") == 0.0 and one(spark, tx.broken_glyph_rate, "ชื=อ") > 2


def test_rules_marks_and_spans(spark):
    rules = lambda s, doc: [(f["text"], f["suggestion"]) for f in one(spark, lambda c: tx.rule_findings(c, F.lit(doc)), s)]
    assert rules("ทวิ¹⁰", False) == [("¹⁰", "๑๐")]
    assert rules("มาตรา 10", True) == [("10", "๑๐")] and rules("มาตรา 10", False) == [] and rules("มาตรา ๑๐", True) == []
    marks = lambda s, doc=None: [(m["kind"], s[m["start"] : m["end"]]) for m in one(spark, lambda c: tx.digit_marks(c, F.lit(doc).cast("boolean")), s)]
    assert marks("๑ ก ๒๓") == [("digit", "๑"), ("digit", "๒๓")] and marks("พ.ศ. ๒24๗") == [("mixed", "๒24๗")]
    assert marks("มาตรา 14", True) == [("mixed", "14")] and marks("มาตรา 14") == [("digit", "14")] and marks("ไม่มี") == []
    assert one(spark, lambda c: tx.suggest(F.lit("mixed"), c), "๒24๗") == "๒๒๔๗" and one(spark, lambda c: tx.suggest(F.lit("digit"), c), "14") is None


def test_edit_scripts():
    rng = random.Random(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(800):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        blocks = edits.edit_blocks(a, b)
        assert edits.distance(a, b) == plain(a, b) == sum(max(a1 - a0, b1 - b0) for tag, a0, a1, b0, b1 in blocks if tag != "equal")
        assert "".join(a[a0:a1] if tag == "equal" else b[b0:b1] for tag, a0, a1, b0, b1 in blocks) == b


def test_long_texts_are_halved(monkeypatch):
    rng = random.Random(6)
    a = "".join(rng.choices("abcd", k=300))
    b = "".join(rng.choices("abcd", k=280))
    monkeypatch.setattr(edits, "TABLE_BITS", 1000)
    blocks = edits.edit_blocks(a, b)
    assert edits.distance(a, b) == sum(max(a1 - a0, b1 - b0) for tag, a0, a1, b0, b1 in blocks if tag != "equal")


def test_lines_side_by_side_have_the_same_distances():
    rng = random.Random(9)
    for _ in range(60):
        texts = ["".join(rng.choices("abcก", k=rng.randint(1, 70))) for _ in range(rng.randint(1, 6))]
        other = "".join(rng.choices("abcก", k=rng.randint(1, 70)))
        assert edits.Lines(texts).distances(other).tolist() == [edits.distance(t, other) for t in texts]


def test_scores(spark):
    from inkgauge.operators import score

    rows = [("วันที่ ๒", "วันที่ ๗"), ("ประกาศ", "ประกาศ"), ("ประกาศ", "ประ"), ("", "ก"), ("กข", "กxyข"), ("ก", "xy"), ("", "")]
    got = score.line_details(spark.createDataFrame(rows, "truth string, read string").coalesce(1)).collect()
    assert [(r["truth_len"], r["edits"]) for r in got] == [(7, 1), (6, 0), (6, 3), (0, 0), (2, 2), (1, 2), (0, 0)]
    assert [r["cer"] for r in got] == [1 / 7, 0, 0.5, 1, 1, 2, 0]
    assert got[0]["total"]["thai_digit"] == 1 and "thai_digit" not in got[0]["right"] and ("wrong", "๗", "๒") in map(tuple, got[0]["spans"])
    spans = [[tuple(s) for s in r["spans"]] for r in got]
    assert spans[1] == [("ok", "ประกาศ", "")] and spans[2][-1] == ("missing", "กาศ", "กาศ") and spans[3] == [("wrong", "ก", "")] and spans[6] == []
    assert spans[4] == [("ok", "ก", ""), ("wrong", "xy", ""), ("ok", "ข", "")] and spans[5] == [("wrong", "xy", "ก")]


def test_merged_reads_are_cut(spark):
    assert edits.split_read(["ab", "cd"], "a b c d") == ["a b", "c d"] and edits.split_read(["ab", ""], "x") == ["x", ""]
    assert edits.split_read(["ab", "cd"], " ") == [" ", ""] and edits.split_read(["abc", "def"], "ab!def") == ["ab!", "def"]
    rng = random.Random(4)
    for _ in range(200):
        parts = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(3)]
        assert edits.split_read(parts, " ".join(parts)) == parts and "".join(edits.split_read(parts, "x".join(parts))) == "x".join(parts)


def test_best_window_is_the_best_of_all():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(11)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        n, m = len(short), len(long)
        sides = [(short, long), (long, short)][: 2 if n == m else 1]
        best = max(200 * common(x, w) / (n + len(w)) for x, y in sides for w in {y[max(0, i) : i + n] for i in range(1 - n, m)} - {""})
        assert edits.partial_ratio(a, b) == pytest.approx(best)
        assert (edits.partial_ratio(a, b, 80) > 80) == (best > 80)


def test_names(spark):
    assert one(spark, names.safe_file_name, 'a<b>:"/\\|?*c. ') == "a-b--------c" and one(spark, names.safe_file_name, " . ") == "unnamed"
    assert one(spark, names.engine_family, "x-api-num+clean") == "x" and one(spark, names.engine_variant, "x+clean") == "clean" and one(spark, names.engine_base, "x+clean") == "x"
    assert one(spark, names.short, "a" * 30) == "a" * 21 + "…"
    found = spark.range(1).select(names.polygon_box(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((5, 9), (20, 3), (7, 30))])).alias("b")).first()["b"]
    assert tuple(found) == (5, 3, 15, 27)
    html = spark.createDataFrame([("a<b12",)], "t string").select(names.highlight(F.col("t"), tx.rule_findings(F.col("t"), F.lit(True))).alias("h")).first()["h"]
    assert html == 'a&lt;b<mark title="๑๒">12</mark>'


def test_watermarks(spark):
    flat = lambda grey: [grey.get(i, 0) for i in range(256)]
    rows = [(flat({20: 300, 240: 200, 255: 5000}),), (flat({20: 300, 210: 200, 235: 100, 255: 5000}),), (flat({255: 100}),)]
    df = spark.createDataFrame(rows, "h array<int>")
    assert [r["w"] for r in df.select(names.has_watermark(F.col("h")).alias("w")).collect()] == [True, False, False]
