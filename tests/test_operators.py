import json
import random

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import edits
from inkgauge.functions import text as tx
from inkgauge.functions.edits import partial_ratio, similarity, split_read
from inkgauge.operators import filters, layout, match, review, rollup, score, stability, suspect
from inkgauge.sources import store

WRAPPED = ["กฎกระทรวง ฉบับที่ ๑ ออกตามความในประมวล", "กฎหมายที่ดิน อาศัยอำนาจตามความในมาตรา ๕", "แห่งพระราชบัญญัติให้ใช้ประมวลกฎหมาย"]


def lines(spark, pages, engine=None):
    """{page: lines} as rows; with an engine, reads."""
    rows = [((engine,) if engine else ()) + (p, i, t) for p, ls in pages.items() for i, t in enumerate(ls)]
    df = spark.createDataFrame(rows, ("engine string, " if engine else "") + "page_id string, line_no int, text string")
    return df.withColumn("norm", tx.normalize(F.col("text")))


def aligned(spark, truth, read):
    return match.align(lines(spark, {"p": truth}), lines(spark, {"p": read}, "a"))


def sums(spark, truth, read):
    return score.with_rates(score.page_scores(aligned(spark, truth, read))).first()


def test_merged_paragraph_is_cut_back(spark):
    s = sums(spark, WRAPPED, ["".join(WRAPPED)])
    assert (s["missed"], s["recall"], s["matched_cer"], s["spurious"]) == (0, 1.0, 0.0, 0)
    rows = aligned(spark, WRAPPED, ["".join(WRAPPED)]).orderBy("truth_no").collect()
    assert [r["read"] for r in rows] == WRAPPED and {r["read_no"] for r in rows} == {0}


def test_what_is_not_read_is_missed(spark):
    assert sums(spark, [*WRAPPED, "บรรทัดที่ไม่มีใครอ่านเลยจริงๆ"], ["".join(WRAPPED)])["missed"] == 1
    assert sums(spark, ["และ"], ["ย่อหน้ายาวที่มีคำว่าและอยู่ข้างใน"])["missed"] == 1
    s = sums(spark, WRAPPED, [*WRAPPED, "ลายน้ำ"])
    assert (s["recall"], s["matched_cer"], s["spurious"], s["spurious_chars"]) == (1.0, 0.0, 1, 6)


def test_matching_is_one_to_one_and_equals_the_native_loop(spark):
    rng = random.Random(2)
    truth = {f"p{k}": ["".join(rng.choices("กขค", k=rng.randint(1, 5))) for _ in range(6)] for k in range(8)}
    read = {p: ["".join(rng.choice("กขค") if rng.random() < 0.2 else c for c in t) for t in ls[:5]] for p, ls in truth.items()}
    t, r = lines(spark, truth), lines(spark, read, "a")
    native = match.mutual_best(match.candidates(t, r))
    found = {(x["page_id"], x["truth_no"], x["read_no"]) for x in native.collect()}
    assert len({x[:2] for x in found}) == len({(x[0], x[2]) for x in found}) == len(found)
    streamed = match.best_first(match.candidates(t, r)).collect()
    assert found == {(x["page_id"], x["truth_no"], x["read_no"]) for x in streamed} and len(streamed) == len(found)
    for p in truth:
        ranked = sorted(((similarity(a, b), i, j) for i, a in enumerate(truth[p]) for j, b in enumerate(read[p])), reverse=True)
        mine = {}
        for s, i, j in ranked:
            if s >= match.THRESHOLD and i not in mine and j not in mine.values():
                mine[i] = j
        assert {x[1:] for x in found if x[0] == p} == set(mine.items())


def plain_align(truth, reads):
    """What ``align`` defines, for a page of lines without spaces, pair by pair."""
    seat, whole = {}, []
    for s, i, j in sorted(((similarity(a, b), i, j) for i, a in enumerate(truth) for j, b in enumerate(reads) if a and b), reverse=True):
        if s >= match.THRESHOLD and i not in seat and j not in seat.values():
            seat[i] = j
    found = dict(seat)
    for i, a in enumerate(truth):
        inside = [(partial_ratio(a, b), -j) for j, b in enumerate(reads) if a and i not in found and len(b) > match.LONGER * len(a)]
        if inside and max(inside)[0] > match.WINDOW:
            seat[i] = -max(inside)[1]
    for i in sorted(set(seat) - set(found)):
        beside = [seat.get(i - 1), seat.get(i + 1)]
        if seat[i] not in beside:
            best = max(((partial_ratio(truth[i], reads[j]), -k, j) for k, j in enumerate(beside) if j is not None), default=(0, 0, 0))
            seat[i] = best[2] if best[0] > match.WINDOW else seat[i]
    out = {i: (j, reads[j]) for i, j in found.items()}
    for j in {seat[i] for i in set(seat) - set(found)}:
        members = sorted(i for i in seat if seat[i] == j)
        if similarity("".join(truth[i] for i in members), reads[j]) >= match.GROUP:
            out |= {i: (j, piece) for i, piece in zip(members, split_read([truth[i] for i in members], reads[j]))}
    used = {j for j, _ in out.values()}
    return {(i, *out.get(i, (None, ""))) for i, a in enumerate(truth) if a} | {(None, j, b) for j, b in enumerate(reads) if b and j not in used}


def test_align_against_plain_pages(spark):
    rng = random.Random(12)
    letters = "กขคงจฉชซฌญ"
    word = lambda lo, hi: "".join(rng.choices(letters, k=rng.randint(lo, hi)))
    noise = lambda t, p: "".join(rng.choice(letters) if rng.random() < p else c for c in t)
    truth, read = {}, {}
    for k in range(60):
        ls = [word(2, 14) for _ in range(rng.randint(1, 9))]
        ls += rng.choices([*ls, ""], k=rng.randint(0, 2))
        out, at = [], 0
        while at < len(ls):
            n = rng.choice([1, 1, 2, 3])
            out.append(noise("".join(ls[at : at + n]), rng.choice([0, 0.05, 0.3])))
            at += n
        if rng.random() < 0.5:
            rng.shuffle(out)
        truth[f"p{k}"], read[f"p{k}"] = ls, [x for x in out if rng.random() < 0.9] + [word(1, 20)]
    rows = match.align(lines(spark, truth), lines(spark, read, "a")).collect()
    got = {p: {(r["truth_no"], r["read_no"], r["read"]) for r in rows if r["page_id"] == p} for p in truth}
    assert len(rows) == sum(map(len, got.values()))
    assert got == {p: plain_align(truth[p], read[p]) for p in truth}


def test_usual_pages_are_matched_without_staging_and_as_long_ones(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda lo, hi: "".join(rng.choices("กขคงจฉ ", k=rng.randint(lo, hi)))
    truth = {f"p{k}": [word(0, 12) for _ in range(7)] for k in range(12)}
    read = {e: {p: [*ls[:2], "".join(ls[2:5]), *ls[5:], word(1, 30)][: len(p + e)] for p, ls in truth.items() if (p, e) != ("p3", "b")} for e in ("a", "b", "c-1")}
    read["b"]["q"] = ["กข"]
    t, r = lines(spark, truth), lines(spark, read["a"], "a").unionByName(lines(spark, read["b"], "b")).unionByName(lines(spark, read["c-1"], "c-1"))
    staged, real = [], match.stage
    monkeypatch.setattr(match, "stage", lambda df, label: staged.append(label) or real(df, label))
    rows = lambda: sorted((tuple(x) for x in score.compared(match.align(t, r, forms=True, readers=["a", "b", "c-1", "d"])).collect()), key=str)
    whole = rows()
    assert staged == ["long"] and {x[:2] for x in whole} >= {("d", "p0"), ("b", "p3"), ("b", "q")}
    monkeypatch.setattr(match, "LONG", 0)
    assert rows() == whole and len(staged) > 2


def test_unread_lines_have_a_cer_of_one(spark):
    got = match.per_truth_line(aligned(spark, ["กขคง", "จฉช"], ["กขคข"])).orderBy("truth_no").collect()
    assert [(r["truth_no"], r["cer"]) for r in got] == [(0, 0.25), (1, 1.0)]


def test_long_lines_have_the_same_distance(spark):
    rng = random.Random(7)
    a = "".join(rng.choices("กขค ab", k=3000))
    b = "".join(rng.choice("กข") if rng.random() < 0.2 else c for c in a)
    df = spark.createDataFrame([(a, b), (a, a), ("x", b), (None, a)], "a string, b string")
    assert df.where(~match.any_distance(F.col("a"), F.col("b")).eqNullSafe(F.levenshtein("a", "b").cast("long"))).count() == 0


def test_equal_pairs_are_part_of_the_greedy_match(spark):
    t, r = lines(spark, {"p": ["ก", "ก", "ข"]}), lines(spark, {"p": ["ก", "ข"]}, "a")
    assert {(x["truth_no"], x["read_no"]) for x in match.equal_pairs(t, r).collect()} == {(1, 0), (2, 1)}


def test_cheap_distance_is_the_distance(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("ab", k=rng.randint(0, 300))), "".join(rng.choices("ab", k=rng.randint(0, 300)))) for _ in range(60)] + [("a", "a"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(match.cheap_distance(F.col("a"), F.col("b"), 4, 64) != F.levenshtein("a", "b")).count() == 0


def test_missing_pages_count_only_when_asked(spark):
    t = lines(spark, {"p": ["กขค"], "q": ["งจฉ"]})
    pairs = match.align(t, lines(spark, {"p": ["กขค"]}, "a"))
    assert pairs.count() == 1
    assert match.with_missing(pairs, t, spark.createDataFrame([("a",)], "engine string")).where("read_no is null").count() == 1


def test_digits_strict_and_lenient(spark):
    pairs = aligned(spark, ["พ.ศ. ๒๕๖๗ ปี"], ["พ.ศ. 2567 ปี"])
    r = score.digit_report(pairs, "engine").first()
    assert (r["digits"], r["strict_rate"], r["lenient_rate"]) == (4, 0.0, 1.0)
    acc = {x["class"]: x["accuracy"] for x in score.class_accuracy(pairs).collect()}
    assert acc["thai_digit"] == 0 and acc["thai_consonant"] == 1
    assert {(x["expected"], x["got"]) for x in score.confusions(pairs).collect()} == set(zip("๒๕๖๗", "2567"))


@pytest.mark.parametrize("pages, expected", [(1, 0), (2, 1), (3, 1)])
def test_repeated_lines(spark, pages, expected):
    df = lines(spark, {f"d_p{i}": ["หัว", f"เนื้อ{i}"] for i in range(pages)}).withColumn("g", F.lit("d"))
    found = filters.repeated_lines(df, "g")
    assert found.count() == expected
    assert filters.drop_repeated(df, found, "g").count() == 2 * pages - expected * pages


def test_repeated_line_with_spaces_at_its_ends_stays(spark):
    df = lines(spark, {"d_p1": [" หัว "], "d_p2": [" หัว "]}).withColumn("g", F.lit("d"))
    assert filters.drop_repeated(df, filters.repeated_lines(df, "g"), "g").count() == 2


def test_thai_digit_documents(spark):
    df = lines(spark, {"docA_p1": ["๑๒๓๔๕๖", "๗๘๙๐๑"], "docA_p2": ["ไม่มี"], "docB_p1": ["๑๒ 1234567890123"]}).withColumn("engine", F.lit("a"))
    assert {r["page_id"]: r["thai_doc"] for r in filters.thai_digit_pages(df, "engine").collect()} == {"docA_p1": True, "docA_p2": True, "docB_p1": False}


def test_sections(spark):
    df = lines(spark, {"d_p1": ["มาตรา ๑๐", "มาตรา ๑๔๑๓ ให้"], "d_p2": ["มาตรา ๑๑", "มาตรา ๑๒"], "e_p1": ["มาตรา ๑", "มาตรา ๑๒๓"]}, "a")
    r = suspect.section_outliers(df).collect()
    assert [(x["page_id"], x["line_no"], x["digits"], x["guess"]) for x in r] == [("d_p1", 1, "๑๔๑๓", "๑๔")]
    s = suspect.section_suspects(df, suspect.section_outliers(df)).first()
    assert s["text"][s["findings"][0]["start"] : s["findings"][0]["end"]] == "๑๔๑๓"


def test_votes_need_two_that_agree(spark):
    def n(line, peers):
        df = spark.createDataFrame([("k", line, p) for p in peers], "k string, dense string, peer string")
        return [(v["start"], v["end"], v["says"], v["n"]) for v in suspect.votes(df, ["k", "dense"]).collect()]

    assert n("กขค๗", ["กขค๒", "กขค๒"]) == [(3, 4, "๒", 2)]
    assert n("กขค๗", ["กขค๒", "กขค๗"]) == [] and n("กขค๗", ["กขค๒"]) == []


def test_scan_borrows_the_grid_box(spark):
    box = "struct<x:int,y:int,w:int,h:int>"
    rows = [("typ", "d_p1", 0, "ข้อ ๗ ให้ใช้บังคับ", None), ("tes-a", "d_p1", 0, "ข้อ ๒ ให้ใช้บังคับ", (10, 20, 300, 40)), ("pad-a", "d_p1", 0, "ข้อ ๒ ให้ใช้บังคับ", None)]
    df = spark.createDataFrame(rows, f"engine string, page_id string, line_no int, text string, box {box}")
    docs = spark.createDataFrame([(e, "d_p1", False) for e in ("typ", "tes-a", "pad-a")], "engine string, page_id string, thai_doc boolean")
    found = suspect.scan(df, docs).where("engine = 'typ'").collect()
    assert len(found) == 1 and tuple(found[0]["box"]) == (10, 20, 300, 40) and found[0]["box_from"] == "tes-a"
    f = found[0]["findings"][0]
    assert (f["layer"], f["text"].strip(), f["suggestion"]) == ("vote", "๗", "๒")


def test_equal_readings_get_no_normal_form_for_votes(spark, monkeypatch):
    made = []
    real = suspect.normal_form
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda x: seen.add(1) or x)
    monkeypatch.setattr(suspect, "normal_form", lambda c: made.append(c) or real(note(c)))
    cells = [("p", k, e, "ข้อ ๗" if (e, k) == ("a", 0) else "ข้อ ๒") for k in range(20) for e in ("a", "b", "c")]
    grid = spark.createDataFrame(cells, "page_id string, grid_line int, engine string, text string")
    peers = spark.createDataFrame([(x, y) for x in "abc" for y in "abc" if x != y], "target string, peer string")
    got = suspect.vote_suspects(grid, peers).collect()
    assert [(r["engine"], r["grid_line"], r["findings"][0]["suggestion"]) for r in got] == [("a", 0, "๒")] and made and seen.value < 40


def test_peers(spark):
    names = spark.createDataFrame([(n,) for n in ("a-1", "a-2", "b-1", "b-0", "c+clean")], "engine string")
    got = {(r["target"], r["peer"]) for r in suspect.independent_peers(names).collect()}
    assert ("a-1", "b-0") in got and ("a-1", "a-2") not in got and ("a-1", "c+clean") not in got and ("a-1", "b-1") not in got


def test_review(spark):
    df = lines(spark, {"p": ["ข้อ ๒24๗", "ไม่มีเลข"]})
    r = review.review_lines(df, F.lit(None).cast("boolean"), F.col("line_no") == 0)
    s = review.review_summary(r).first()
    assert (s["lines"], s["to_check"], s["mixed"], s["shaky"], s["digit"]) == (2, 1, 1, 1, 0)
    assert review.fixes(r).first()["suggestion"] == "๒๒๔๗"


def test_borrowed_boxes(spark):
    mine = lines(spark, {"p": ["กขคงจ", "ไม่ตรงกับใคร"]}).select("page_id", "line_no", "text")
    donor = spark.createDataFrame([("d", "p", 5, "กขคงจ", (1, 2, 3, 4))], "engine string, page_id string, line_no int, text string, box struct<x:int,y:int,w:int,h:int>")
    got = {r["line_no"]: r["box"] for r in review.borrow_boxes(mine, donor).collect()}
    assert tuple(got[0]) == (1, 2, 3, 4) and got[1] is None


def test_stability_and_rescue(spark):
    rounds = spark.createDataFrame([("p", k, i, t) for k, ls in enumerate([["ก ข", "ค"], ["กข", "ง"], ["กข", "ค"]]) for i, t in enumerate(ls)], "page_id string, round int, line_no int, text string")
    assert {r["line_no"]: r["stable"] for r in stability.stable_lines(rounds, "page_id").collect()} == {0: True, 1: False}
    got = spark.createDataFrame([(["ก ข", "กข"],), (["ก", "ข"],), ([],)], "v array<string>").select(stability.agree(F.col("v")).alias("a")).collect()
    assert [r["a"] for r in got] == [True, False, None]
    items = spark.createDataFrame([("p", 0, "กขค๗", "กขค๒"), ("p", 1, "กขค๒", "กขค๗"), ("q", 0, "ก", "ข")], "page_id string, line_no int, before string, after string")
    v = stability.rescue_verdicts(items, lines(spark, {"p": ["กขค๒", "งงงง"]}))
    assert {(r["page_id"], r["line_no"]): r["verdict"] for r in v.collect()} == {("p", 0): "better", ("p", 1): "worse", ("q", 0): "unknown"}


def test_store_round_trip_and_upsert(spark, tmp_path):
    path = str(tmp_path / "store.json")
    page = {"lines": ["ก", "ข"], "boxes": [[1, 2, 3, 4], None], "confidences": [0.5, None], "core_ms": 1.0, "elapsed_ms": 2.0, "error": None, "read_at": "2024"}
    (tmp_path / "store.json").write_text(json.dumps({"meta": {"k": "v"}, "engines": {"a": {"p": page}}}))
    pages = store.read_store(spark, path)
    long = store.store_lines(pages).orderBy("line_no").collect()
    assert [r["text"] for r in long] == ["ก", "ข"] and tuple(long[0]["box"]) == (1, 2, 3, 4) and long[1]["box"] is None and long[1]["confidence"] is None
    again = store.nest_lines(store.store_lines(pages)).first()
    assert again["lines"] == page["lines"] and again["boxes"] == page["boxes"] and again["confidences"] == page["confidences"]
    assert store.read_meta(spark, path).collect()[0]["value"] == "v" and store.read_store(spark, str(tmp_path / "none")).count() == 0
    old = spark.createDataFrame([("a", "p", "1"), ("a", "q", "1"), ("b", "p", "1")], "engine string, page_id string, t string")
    new = spark.createDataFrame([("a", "p", "2"), ("a", "p", "3")], "engine string, page_id string, t string")
    got = {(r["engine"], r["page_id"]): r["t"] for r in store.upsert(old, new, ["engine", "page_id"], "t").collect()}
    assert got == {("a", "p"): "3", ("a", "q"): "1", ("b", "p"): "1"}


def test_run_log(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"started_at":"1","pages":1}\n\n{"started_at":"2","pages":2}\n{"torn')
    path = str(tmp_path / "runs.jsonl")
    assert [r["started_at"] for r in store.read_runs(spark, path).collect()] == ["2", "1"] and store.read_runs(spark, path, 1).count() == 1
    (tmp_path / "pages.jsonl").write_text("".join(json.dumps({"run": str(k), "engine": "a", "page_id": p, "ok": True}) + "\n" for k, p in enumerate(["doc1_p1", "doc1_p10", "doc1_p1"])))
    assert [r["run"] for r in store.read_page_history(spark, str(tmp_path / "pages.jsonl"), "doc1_p1").collect()] == ["2", "0"]
    stamps = spark.createDataFrame([("c",), ("a",), ("",), (None,), ("b",)], "started_at string")
    assert {r["started_at"]: r["rank"] for r in rollup.run_order(stamps).collect()} == {"a": 1, "b": 2, "c": 3}


def test_runs_of_several_files_come_last_first(spark, tmp_path):
    path = str(tmp_path / "runs")
    for k in (1, 2, 3, 4):
        store.append_json(spark.createDataFrame([(f"2024-01-0{k}", k)], "started_at string, pages int"), path)
    assert [r["pages"] for r in store.read_runs(spark, path).collect()] == [4, 3, 2, 1] and store.read_runs(spark, path, 1).first()["pages"] == 4


def test_columns_of_the_users_stay(spark):
    old = spark.createDataFrame([("a", 1, 7)], "k string, _rank int, _new int")
    assert [tuple(r) for r in store.upsert(old, old.withColumn("_rank", F.lit(2)), ["k"]).collect()] == [("a", 2, 7)]
    assert filters.by_priority(old, ["k"], F.col("_rank")).columns == old.columns


def test_markdown_export(spark):
    pages = spark.createDataFrame([("d", "a", 1, "p1", ["ก"]), ("d", "a", 2, "p2", []), ("d", "a", 3, "p3", ["raw"])], "doc string, engine string, page_no int, page_id string, lines array<string>")
    edits = spark.createDataFrame([("p3", "a", "แก้แล้ว\n"), ("p1", "b", "x")], "page_id string, engine string, text string")
    md = store.export_markdown(pages, edits).first()
    assert md["edited"] == 1 and store.EMPTY_PAGE in md["markdown"] and "แก้แล้ว" in md["markdown"] and "raw" not in md["markdown"] and "<!-- page 1 · p1 -->" in md["markdown"]


def test_markdown_export_makes_a_text_in_its_aggregate(spark):
    rows = [("d", "a", 2, "p2", ["y", "", " "]), ("d", "a", 1, "p1", ["x", ""]), ("d", "a", 3, None, ["z"]), ("e", "a", 1, None, ["z"]), (None, "a", 1, "p4", ["z"])]
    pages = spark.createDataFrame(rows, "doc string, engine string, page_no int, page_id string, lines array<string>")
    md = store.export_markdown(pages, spark.createDataFrame([], "page_id string, engine string, text string"), F.lit("2024-01-01").cast("timestamp"))
    head = lambda doc, n: f"# {doc}\n\n> read by `a` · {n} pages · made 2024-01-01 00:00\n"
    got = {r["doc"]: (r["markdown"], r["pages"]) for r in md.collect()}
    assert got == {"d": (head("d", 3) + "\n---\n\n<!-- page 1 · p1 -->\n\nx\n\n\n---\n\n<!-- page 2 · p2 -->\n\ny\n", 3), "e": (head("e", 1), 1), None: (None, 1)}
    # a document's blocks are as large as its text: they don't leave the aggregate as an array beside it
    made = next(x for x in md._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [doc" in x)
    assert ", array_sort(" not in made


def test_layout(spark):
    words = spark.createDataFrame([("p", 1, 1, 1, 1, 0, 0, 10, 10, 90.0, "a"), ("p", 1, 1, 1, 2, 11, 0, 10, 10, -1.0, "b"), ("p", 1, 1, 1, 3, 40, 2, 10, 10, 80.0, "c")], layout.WORDS)
    b = layout.line_boxes(words).first()
    assert b["confidence"] == 0.85 and tuple(b["box"]) == (0, 0, 50, 12)
    text = lambda how: layout.line_texts(words, how).first()["text"]
    assert (text("naive"), text("tight"), text("gap")) == ("a b c", "abc", "ab c")


def test_progress(spark):
    row = spark.createDataFrame([("a", 0, 2, 3, 10, "p", 2.0, None, "2024-01-01T00:00:00+00:00", False, 0)], store.STATUS)
    p = rollup.progress(row, F.lit("2024-01-01 00:10:00").cast("timestamp")).first()
    assert (p["engine_fraction"], p["overall_fraction"], p["eta_seconds"], p["stale"], p["running"]) == (0.3, 0.15, 34.0, True, False)


def test_log_stream(spark, tmp_path):
    from inkgauge.streaming import logs

    src = tmp_path / "log"
    src.mkdir()
    row = lambda k, p: json.dumps({"run": str(k), "engine": "a", "page_id": p, "ok": True, "ms": 1.0, "lines": [str(k)], "error": None, "at": f"2024-01-01T00:0{k}:00Z"}) + "\n"
    (src / "1.json").write_text(row(1, "p") + row(2, "q"))
    run = lambda: logs.keep_latest(logs.page_log(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    (src / "2.json").write_text(row(3, "p"))
    run()
    got = {r["page_id"]: r["run"] for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()}
    assert got == {"p": "3", "q": "2"}


def test_all_readers_are_scored_by_matching(spark, monkeypatch):
    from inkgauge.plans import queries, reads as made

    truth = lines(spark, {"a_p1": WRAPPED, "a_p2": WRAPPED[:2]}).withColumn("doc", F.lit("a"))
    read = lines(spark, {"a_p1": WRAPPED, "a_p2": ["x"]}, "alpha").unionByName(lines(spark, {"a_p1": ["".join(WRAPPED)]}, "gamma-x"))
    monkeypatch.setattr(made, "truth", lambda *_: truth)
    monkeypatch.setattr(made, "reads", lambda *_: read)
    monkeypatch.setattr(made, "ENGINES", ("alpha", "gamma-x"))
    runs = [(e, p, ms, None if ms else "no answer") for e, p, ms in (("alpha", "a_p1", 9.0), ("alpha", "a_p2", 1.0), ("gamma-x", "a_p1", 2.0), ("gamma-x", "a_p2", None))]
    monkeypatch.setattr(made, "runs", lambda *_: spark.createDataFrame(runs, "engine string, page_id string, core_ms double, error string"))
    got = {(r["engine"], r["page_id"]): (r["truth_lines"], r["found"], r["missed"], r["spurious"], r["edits"]) for r in queries.matched_page_scores(spark, "").collect()}
    assert got == {("alpha", "a_p1"): (3, 3, 0, 0, 0), ("alpha", "a_p2"): (2, 0, 2, 1, 0), ("gamma-x", "a_p1"): (3, 3, 0, 0, 0), ("gamma-x", "a_p2"): (2, 0, 2, 0, 0)}
    board = {r["engine"]: r for r in queries.matched_leaderboard(spark, "").where("doc is null").collect()}
    assert board["alpha"]["recall"] == 3 / 5 and board["gamma-x"]["recall"] == 1 and board["gamma-x"]["cer"] == 0 and board["gamma-x"]["seconds"] == 0.002
    matrix = {r["class"]: r for r in queries.accuracy_by_class(spark, "").collect()}
    assert matrix["thai_digit"]["alpha"] == matrix["thai_digit"]["gamma-x"] == 1
    assert {r["engine"] for r in queries.class_accuracy(spark, "").collect()} == {r["engine"] for r in queries.all_page_error_rates(spark, "").collect()} == {"alpha", "gamma-x"}
    assert queries.matched_leaders(spark, "").first()["best_recall"] == "gamma-x"


def test_page_error_rates_have_every_reader(spark, monkeypatch):
    from inkgauge.plans import queries, reads as made

    monkeypatch.setattr(made, "truth", lambda *_: lines(spark, {"p": WRAPPED}))
    monkeypatch.setattr(made, "reads", lambda *_: lines(spark, {"p": WRAPPED}, "alpha").unionByName(lines(spark, {"p": ["".join(WRAPPED)]}, "gamma-x")).unionByName(lines(spark, {"p": [*WRAPPED, "กข"]}, "beta")))
    assert {r["engine"]: r["page_edits"] for r in queries.page_error_rates(spark, "").collect()} == {"alpha": 0, "beta": 2, "gamma-x": 0}
    assert "engine = 'beta'" not in queries.SQL["page_error_rates"].split("t as (select page_id")[1]


def test_histories_and_repairs_take_whole_texts(spark, tmp_path, monkeypatch):
    from inkgauge.plans import queries, reads as made

    rows = [(1, 1, "user", "año 1"), (1, 2, "user", "año 1"), (1, 3, "user", "ano 1"), (1, 4, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = [(r["chars"], r["arabic_digits"], r["change"]) for r in queries.whole_round_history(spark, f"file://{tmp_path}").orderBy("round").collect()]
    assert got == [(5, 1, None), (5, 1, 0.0), (5, 1, 0.2), (0, 0, 1.0)]
    monkeypatch.setattr(made, "truth", lambda *_: spark.createDataFrame([("p", 0, "ทำ @@"), ("p", 1, "กา")], "page_id string, line_no int, text string"))
    assert {r["line_no"]: r["repaired"] for r in queries.truth_repair(spark, "").collect()} == {0: "ทำ @@", 1: "ก า"}


def test_variants_are_marked_in_the_line(spark):
    from inkgauge.functions.edits import variants_html

    mark = lambda tip, text: f'<span class="wrong" data-tip="another round reads: {tip}">{text}</span>'
    rows = [("abcdef", ["abXdef", "aYYdef"]), ("a<b", ["a<b"]), ("abc", ["ac", "abc!"]), ("", ["x"]), ("ab", ["a&b"]), (None, ["x"])]
    got = [r["h"] for r in spark.createDataFrame(rows, "line string, others array<string>").coalesce(1).select(variants_html(F.col("line"), F.col("others")).alias("h")).collect()]
    assert got == ["a" + mark("YY", "bc") + "def", "a&lt;b", "a" + mark("(left out)", "b") + "c", "", "a" + mark("&amp;", "b"), None]


def test_batches_have_the_same_distances():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("กขคงab😀", k=n))
    xs, ys = [word(rng.randint(1, 150)) for _ in range(120)], [word(rng.randint(1, 200)) for _ in range(120)]
    assert edits.distances(xs, ys).tolist() == [edits.distance(x, y) for x, y in zip(xs, ys)]
    assert edits.distances(xs, ys, True).tolist() == [edits._nearest(x, y)[0] for x, y in zip(xs, ys)]
    held = [y[:20] + x + y[20:] for x, y in zip(xs, ys)]
    for x, y, s in zip(xs + xs, ys + held, edits.windows(xs + xs, ys + held, 80.0)):
        whole = edits.partial_ratio(x, y)
        assert s == whole if whole > 80 else s <= 80


def test_equal_texts_are_compared_once(monkeypatch):
    asked = []
    real = edits.distances
    monkeypatch.setattr(edits, "distances", lambda xs, ys, inside=False: asked.extend(xs) or real(xs, ys, inside))
    block = ([0, 1], ["กขค", "กขง"], [0, 1, 2], ["กขคง", "กขค", "ก" * 9])
    first, second = edits.like_lines([block, block], 0.45)
    assert sorted(first) == sorted(second) == [(0, 0, 0.75), (0, 1, 1.0), (1, 0, 0.75), (1, 1, 1 - 1 / 3)]
    assert len(asked) == 4


def test_normal_form_is_that_of_the_expressions(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(tx.MARKS + "กํา “–²  \x1c\x85a1\n", k=rng.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.normalize(F.col("text")).alias("a"), edits.normal_form(F.col("text")).alias("b"), tx.has_text(F.col("text")).alias("any"))
    assert rows.where("a <> b or any <> (a <> '')").count() == 0


@pytest.mark.parametrize("gone, more, changed", [(0, 0, 5), (0, 9, 100), (900, 0, 40), (0, 700, 0), (400, 400, 900), (3000, 3000, 0)])
def test_long_texts_are_compared_in_a_band(gone, more, changed, monkeypatch):
    rng = random.Random(gone + more + changed)
    word = lambda n: rng.choices("กขคงจฉชซab๑", k=n)
    x, asked = word(9000), []
    y = x[:2000] + word(more) + x[2000 + gone :]
    for i in rng.sample(range(len(y)), changed):
        y[i] = rng.choice("กขคง")
    x, y = "".join(x), "".join(y)
    whole = edits.distance
    monkeypatch.setattr(edits, "distance", lambda a, b: asked.append(a) or whole(a, b))
    assert edits.long_distance(x, y) == edits.long_distance(y, x) == whole(x, y)
    assert more == 3000 or not any(len(a) > 4000 for a in asked)


def test_classes_are_counted_as_the_expressions_do(spark):
    text = "".join(map(chr, [*range(1, 0xD800), 0x1F600, 0x20000])) + "กข๑๑๒ ab1"
    native = spark.createDataFrame([(text[k : k + 997],) for k in range(0, len(text), 997)], "t string").select("t", F.array(*tx.class_counts(F.col("t"))).alias("n")).collect()
    assert abs(edits.count_classes([r["t"] for r in native]) - [r["n"] for r in native]).sum() <= 2 * 1000  # letters that one side's version of Unicode lacks
    usual = ["กa๑1ฯé !", text[0x0E00:0x0E80], ""]
    rows = spark.createDataFrame([(t,) for t in usual], "t string").coalesce(1).select(F.array(*tx.class_counts(F.col("t"))).alias("n")).collect()
    assert edits.count_classes(usual).tolist() == [r["n"] for r in rows]


def test_scores_need_no_script_twice(spark, monkeypatch):
    import pandas as pd

    calls = []
    monkeypatch.setattr(edits, "edit_blocks", lambda a, b, f=edits.edit_blocks: calls.append((a, b)) or f(a, b))
    run = edits._pairwise(edits._digits)
    got = run(pd.Series(["ก๑๒", "ก๑๒", "กข", None]), pd.Series(["ก๑2", "ก๑2", "กค", "ก"]))
    assert list(got) == [(2, 1, 2, 2), (2, 1, 2, 2), (0, 0, 0, 0), None] and len(calls) == 1
    assert edits.any_distances(["ab", None, "", "กข" * 2000, "ab"], ["ac", "x", "abc", "กข" * 1999 + "กx", "ac"]) == [1, None, 3, 1, 1]


def test_forms_that_matching_knows_are_not_made_again(spark):
    t, r = lines(spark, {"p": WRAPPED, "q": ["ก"]}), lines(spark, {"p": ["".join(WRAPPED), "ลายน้ำ"]}, "a")
    engines = spark.createDataFrame([("a",)], "engine string")
    plain, known = (match.with_missing(match.align(t, r, forms=f), t, engines) for f in (False, True))
    key = lambda df: sorted((tuple(x) for x in score.compared(df).select("page_id", "truth_no", "read_no", "t", "p").collect()), key=str)
    assert key(plain) == key(known) and {"t", "p"} <= set(known.columns) and not {"t", "p"} & set(plain.columns)


def test_a_scan_reads_its_lines_once(spark):
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda x: seen.add(1) or x)
    rows = [(e, "d_p1", k, f"ข้อ {d} ให้ใช้", (1, 2, 3, 4)) for e, d in (("typ", "๗"), ("tes-a", "๒"), ("pad-a", "๒")) for k in range(2)]
    df = spark.createDataFrame(rows, "engine string, page_id string, line_no int, text string, box struct<x:int,y:int,w:int,h:int>").withColumn("text", note("text"))
    docs = spark.createDataFrame([(e, "d_p1", False) for e in ("typ", "tes-a", "pad-a")], "engine string, page_id string, thai_doc boolean")
    suspect.scan(df, docs).collect()
    assert seen.value == len(rows)
