"""The corpus operators against brute force, round trips and held-out rows, and on odd tables."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from inkgauge.llm import exact, html, kneser, langid, lattice, mixing, packing, sharding, shingles, simhash, tokens
from inkgauge.llm.components import connected_components
from inkgauge.llm.encode import Encoder, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \t\n", "en", "a", 3), (4, "word " * 5000, "en", "a", 25000), (5, "x y", "en", "b", 3), (5, "x y", "en", "b", 3), (None, "x y", "en", "b", 3), (7, "Ünï çødé x y ,", "de", "b", 14)]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [r.asDict() for r in documents.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("_rank", F.lit(1)).withColumn("_sha", F.lit("s")).withColumn("size", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    groups = collections.defaultdict(set)
    for node, root in got.items():
        groups[root].add(want[node])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({want[n] for n in got})
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- token ids and packing ------------------------------------------------------------------------


def test_encoder_equals_the_library():
    tool, rng = Encoder(vocabulary_path(), 50, 50), random.Random(3)
    texts = ["it's <|endoftext|>a", "á ́b\n x  y\t\tz\x85q\x1cw!!\x1c?", "34@mail7.example.com\tÀÖ×÷ß\xa0¼²ªº µ a\xadb", "ΣΑΣ ΑΣ.\r\nİ", ""]
    texts += ["".join(rng.choices("ab É.,'<|\n\t1²ß\xa0\x85\x1céZก", k=60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(tool.encode(t), "<u4").tolist() == tool.tokenizer.encode(t, add_special_tokens=False).ids


def expected_ids(text, end):
    return [*Encoder(vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_token_table_round_trip(spark, documents, rows, tmp_path):
    path = "file://" + str(tmp_path / "t")
    tokens.write_tokens(documents, path)
    got = {r["doc_id"]: r for r in tokens.read_digests(spark, path).collect()}
    at, tool = 0, Encoder(vocabulary_path())
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = tool.encode(r["text"]) + np.array([1], "<u4").tobytes()
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    some = {r["doc_id"]: r["ids"] for r in tokens.lookup(spark, path, [3, 77]).collect()}
    assert some == {i: expected_ids(next(r["text"] for r in rows if r["doc_id"] == i), 1) for i in (3, 77)}


def test_ids_of_every_document_are_the_librarys(documents, rows):
    from tokenizers import Tokenizer

    tool, at = Tokenizer.from_file(vocabulary_path()), 0
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_table(documents, end_id=1).collect()}
    crc = {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in packing.pack(documents, end_id=0).collect()}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = tool.encode(r["text"] or "", add_special_tokens=False).ids
        assert found[r["doc_id"]] == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        at += len(ids) + 1
        for k in range(0, len(ids) + 1, 2048):
            cut = [*ids, 0][k : k + 2048]
            assert crc.pop((r["doc_id"], k // 2048)) == (len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    assert not crc


def test_lookup_in_blocks_that_begin_with_null_ids(spark, tmp_path):
    path = "file://" + str(tmp_path / "n")
    tokens.write_tokens(spark.createDataFrame([(None, "x"), (None, None), (1, "a b"), (2, "c"), (2, "d")], "doc_id long, text string"), path)
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in tokens.lookup(spark, path, [1, 2, 9]).collect())
    assert got == sorted([(1, tuple(expected_ids("a b", 1))), (2, tuple(expected_ids("c", 1))), (2, tuple(expected_ids("d", 1)))])


def test_token_tables_of_copies_have_a_dictionary(spark, tmp_path):
    path = "file://" + str(tmp_path / "c")
    tokens.write_tokens(spark.createDataFrame([(None, "one and the same text")] * 4000, "doc_id long, text string"), path)
    assert spark.read.parquet(path + "/dictionary").first()["samples"] == 1 and tokens.read_digests(spark, path).count() == 4000


def test_token_table_of_odd_rows(odd, empty):
    got = tokens.token_table(odd).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 7] and [r["n_tokens"] for r in got][1:4] == [1, 1, 1]
    assert tokens.token_table(empty).count() == 0


def check_packing(got, rows, end=0, capacity=2048):
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for seats in by.values():
        at = 0
        for offset, length in sorted(seats):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want, tool = collections.Counter(), Encoder(vocabulary_path())
    for doc_id, text in rows:
        ids = tool.encode(text) + np.array([end], "<u4").tobytes()
        for k, s in enumerate(range(0, len(ids), 4 * capacity)):
            cut = ids[s : s + 4 * capacity]
            want[doc_id, k, s // 4, len(cut) // 4, zlib.crc32(cut)] += 1
    assert pieces == want
    return len(by), sum(n for seats in by.values() for _, n in seats)


def test_packing(documents, rows, odd, empty):
    used, total = check_packing(packing.pack(documents).collect(), [(r["doc_id"], r["text"]) for r in rows])
    assert used <= 1.05 * -(-total // 2048) + 1
    check_packing(packing.pack(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack(empty).count() == 0
    for s in packing.sequences(packing.pack(odd, with_ids=True)).collect():
        assert s["length"] == len(s["ids"]) <= 2048


def test_packing_plans():
    rng = random.Random(1)
    for counts in ({700: 10}, {1: 5}, {2048: 3, 2047: 2, 1: 2}, {1024: 9}, {rng.randint(1, 64): rng.randint(1, 9) for _ in range(40)}):
        capacity = 64 if max(counts) <= 64 else 2048
        made, placed = packing.plan(counts, capacity), collections.Counter()
        for bins, runs in made:
            assert bins > 0 and sum(x * n for x, n in runs) <= capacity
            for x, n in runs:
                placed[x] += bins * n
        assert placed == collections.Counter(counts)


# -- pages ---------------------------------------------------------------------------------------------


def test_page_text():
    t = "<html><body><header>Site</header><div id=sidebar>x</div><article><h1>T &amp; &eacute;</h1><p><b>a  b<br><p>c<nav>m</nav><div class='comments'>no</div></article><footer>f</footer>"
    assert html.main_texts([html.page_blocks(t)]) == ["T & é\na b\nc"]
    assert html.page_blocks(None) == [] and html.main_texts([[], []]) == ["", ""]


def test_repeated_runs_go_and_unique_text_stays():
    menu = "<div>Home News About Contact Imprint Privacy Terms Jobs Press</div>"
    pages = [html.page_blocks(f"<body>{menu}<p>{body}</p>") for body in ("one of a kind text here", "another text of its own")]
    assert html.main_texts(pages) == ["one of a kind text here", "another text of its own"]
    rng = random.Random(9)
    words = [[rng.choice("ab") for _ in range(rng.randint(0, 30))] for _ in range(5)]
    for mine, marks in zip(words, html.repeated(words, 4)):
        others = [o for o in words if o is not mine]
        want = [False] * len(mine)
        for i in range(len(mine) - 3):
            if any(o[j : j + 4] == mine[i : i + 4] for o in others for j in range(len(o) - 3)):
                want[i : i + 4] = [True] * 4
        assert marks == want


def test_pages_query_against_plain_reading(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    import html as entities

    for p in pages.collect():
        inner = re.search("<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        blocks = [entities.unescape(re.sub("</?b>", "", b)) for b in re.split("</?(?:p|h1|br)>", inner)]
        text = "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)
        assert got[p["page_id"]] == (text, len(text))
    odd = spark.createDataFrame([(1, None, None, 0), (1, None, None, 0), (None, "x", "<p>a", 1)], "page_id long, url string, html string, host int")
    assert sorted(r["text"] for r in html.extract(odd).collect()) == ["", "", "a"] and html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<div class='layout has-sidebar'><article><p>Main text</p></article><div class=sidebar>aside</div></div>", "Main text"),
    ("<form id=aspnetForm><div>menu words</div><article><p>Main text</p></article></form>", "Main text"),
    ("<div class='page with-menu'><p>Only wrapped text</p></div>", "Only wrapped text"),
    ("<article><p>Main text</p></article><div class=comments><article class=comment>I disagree</article></div>", "Main text"),
    ("<div class='no-sidebar'><main><p>Main text</p><section class='comments'><article>I disagree</article></section></main></div>", "Main text"),
    ("<article><p>Main text</p><form><p>Your name</p></form><div class=share>Share</div></article>", "Main text"),
    ("<nav><article>teaser</article></nav><p>Open text</p>", "Open text"),
    ("<div class='widget'>Weather</div><p>Open text</p>", "Open text"),
])
def test_wrappers_and_forms(page, text):
    assert html.main_texts([html.page_blocks(f"<body>{page}</body>")]) == [text]


def test_pages_that_are_stored_twice_keep_their_text(spark):
    body = "<body><p>this page has no article but it has nine words or more</p><p>and it is stored under two addresses of the host</p></body>"
    other = "<body><p>quite another page with a text of its own and nothing shared with it</p></body>"
    data = [(1, "http://h/a", body), (2, "http://h/b", body), (2, "http://h/b", body), (3, "http://h/c", other)] + [(10 + k, "http://h/x", body) for k in range(70)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    for size in (512, 16, 1):
        got = html.extract(pages, group_pages=size).collect()
        assert len(got) == len(data) and all(r["text"].count("\n") == (0 if r["page_id"] == 3 else 1) for r in got)


def test_runs_are_found_across_groups_of_a_large_host(spark):
    line = "<div>only two pages of this whole host carry this very line of text</div>"
    data = [(k, f"http://big.example/{k}", f"<body>{line if k in (3, 60) else ''}<p>{' '.join(f'w{k}x{i}' for i in range(12))}</p>") for k in range(80)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for size in (40, 8, 1):
        assert {r["page_id"]: r["text"] for r in html.extract(pages, group_pages=size).collect()} == whole
    assert len(whole) == 80 and all("carry" not in x for x in whole.values())


def test_repetition_judges_blocks_in_and_beside_articles(spark):
    def page(k):
        own, note = (" ".join(f"{c}{k}x{i}" for i in range(12)) for c in "wn")
        shared = "<p>a passage that two articles quote word for word</p>" if k in (1, 2) else ""
        return f"<body><div>Our site has all the news of the day for you</div><div>{note}</div><article><p>{own}</p>{shared}<p>Share this text with friends</p></article>"

    data = [(k, f"http://a.example/{k}", page(k)) for k in range(40)] + [(100 + k, f"http://b.example/{k}", "<article><p>one text that is crawled again and again</p></article>") for k in range(9)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    for size in (512, 8):
        got = {r["page_id"]: r["text"] for r in html.extract(pages, group_pages=size).collect()}
        assert all("Share this" not in got[k] and "Our site" not in got[k] and f"w{k}x0" in got[k] and f"n{k}x0" in got[k] for k in range(40))
        assert all("two articles quote" in got[k] for k in (1, 2)) and all(got[100 + k].startswith("one text") for k in range(9))


# -- sharding, exact copies, mixing --------------------------------------------------------------------------


def test_sharding(documents, rows, odd, empty):
    got = sharding.shard_by_bytes(documents, 7).collect()
    assert len(got) == len(rows)
    by, loads = collections.defaultdict(list), collections.Counter()
    for r in got:
        by[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(loads.values()) <= 1.05 * sum(loads.values()) / 7
    text = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 16, zlib.crc32(text[r["doc_id"]])) for r in got)
    assert sharding.shard_by_bytes(odd, 3).count() == len(ODD) and sharding.shard_by_bytes(empty, 3).count() == 0


def test_shards_against_the_rules(spark, documents, odd, tmp_path):
    """Every record once, sums as the contract says, and a map whose versions move only edited slots."""
    for k, df in enumerate((documents, odd.unionByName(spark.createDataFrame([(None, "copy", "en", "a", 4)] * 500, DOCS), allowMissingColumns=True))):
        path = f"file://{tmp_path}/map{k}"
        got = [tuple(r) for r in sharding.shard_by_bytes(df, 5, 256, path).orderBy("shard", "slot").collect()]
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert sorted((str(r[0]), r[1], r[2]) for r in got) == want and {r[3] for r in got} == {"bytes"} and {r[8] for r in got} == {1}
        assert got == [tuple(r) for r in sharding.shard_by_bytes(df.repartition(7), 5, 256).orderBy("shard", "slot").collect()]
        records = sharding.slotted(df, 256)
        grown = sharding.grow_map(spark, path)
        again = sharding.read_map(spark, path)
        assert (again.version, again.shards, again.shard_of) == (2, 6, grown.shard_of)
        first = {(r["doc_id"], r["text_crc32"], r["size"], r["nth"]): (r["vslot"], r["shard"]) for r in sharding.place(records, path, 1).collect()}
        second = {(r["doc_id"], r["text_crc32"], r["size"], r["nth"]): (r["vslot"], r["shard"]) for r in sharding.place(records, path).collect()}
        assert all(second[x] == v or (v[0] in set(grown.moved) and second[x][1] == 5) for x, v in first.items())
        assert sharding.rebalance_map(records, path).version == 3 and sharding.read_map(spark, path, 1).shards == 5
    copies = collections.Counter(r[4] for r in got if r[1] == 20 and r[0] is None)
    assert len(copies) == 5


def test_slot_map_edits():
    rng = random.Random(2)
    size = [rng.randint(1, 100) for _ in range(500)]
    first = sharding.SlotMap.build(size, [1] * 500, 8)
    grown = first.grow()
    assert grown.version == 2 and {grown.shard_of[s] for s in grown.moved} == {8}
    assert all(a == b for s, (a, b) in enumerate(zip(first.shard_of, grown.shard_of)) if s not in set(grown.moved))
    assert max(grown.loads()) <= max(first.loads()) and min(grown.loads()) > 0.8 * sum(size) / 9
    changed = [x * 5 if first.shard_of[s] == 0 else x for s, x in enumerate(size)]
    again = first.rebalance(changed, [1] * 500)
    assert max(again.loads()) < max(sharding.SlotMap(8, first.shard_of, changed, [1] * 500).loads())


def test_exact_groups(documents, rows, odd, empty):
    for df, data in ((documents, [(r["doc_id"], r["text"]) for r in rows]), (odd, [(r[0], r[1]) for r in ODD])):
        groups = collections.defaultdict(list)
        for doc_id, text in data:
            groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
        got = exact.exact_groups(df, 0.02).collect()
        keep = {key: sorted(g)[0][3] for key, g in groups.items()}
        import hashlib

        by = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
        assert len(got) == len(data) and sum(r["kept"] for r in got) == len(groups)
        assert all(r["keep_id"] == keep[by[r["text_sha256"]]] and r["group_size"] == len(groups[by[r["text_sha256"]]]) for r in got)
        stay = exact.exact_dedup(df, 0.02)
        assert stay.columns == df.columns and stay.count() == len(groups)
    assert exact.exact_groups(empty).count() == exact.exact_dedup(empty).count() == 0


def test_mixing(documents, odd, empty):
    got = mixing.mix_report(documents).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(documents).collect()))
    assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    total = sum(r["size"] for r in got)
    targets = {(r["source_size"], r["target"]) for r in mixing.source_targets(mixing.document_sizes(documents)).collect()}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1 and all(t <= 2 * s + 1e-6 for s, t in targets)
    longest, by_source, of = collections.Counter(), collections.Counter(), {r["doc_id"]: r["source"] for r in documents.collect()}
    for r in got:
        by_source[of[r["doc_id"]]] += r["taken"]
        longest[of[r["doc_id"]]] = max(longest[of[r["doc_id"]]], r["size"])
    target = {of[r["doc_id"]]: r["target"] for r in got}
    assert all(abs(by_source[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in target)  # the document at which the words cross
    assert mixing.mix(documents).count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.mix_report(odd).count() == len(ODD) and mixing.mix(odd).columns == odd.columns and mixing.mix_report(empty).count() == 0


def test_equal_rows_are_mixed_each_for_itself(spark):
    data = [(None, "one two three", "a")] * 300 + [(7, "four five", "b")] * 300 + [(k, "six", "c") for k in range(300)] + [(1, None, "c"), (2, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("_nth", F.lit("x"))
    taken = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""))).alias("n")).collect()}
    want = {r["source"]: r["target"] for r in mixing.source_targets(mixing.document_sizes(docs)).collect()}
    assert all(abs(taken.get(s, 0) - want[s]) <= 1.5 for s in "abc")
    report = mixing.mix_report(docs).collect()
    assert len(report) == len(data) and sum(r["taken"] for r in report) == sum(n or 0 for n in taken.values())


# -- near duplicates -----------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(documents, rows, odd, empty):
    for df, data in ((documents, [(r["doc_id"], r["text"]) for r in rows]), (odd.where("doc_id is not null"), [(r[0], r[1]) for r in ODD if r[0] is not None])):
        fps = {i: brute_fingerprint(t) for i, t in data}
        ids = sorted(fps)
        want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 4])
        got = simhash.near_duplicate_groups(df).collect()
        assert len(got) == len(data)
        assert all(r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]] for r in got)
    assert simhash.near_duplicate_groups(odd).count() == len(ODD) and simhash.near_duplicate_groups(empty).count() == 0


def test_masks_cover():
    masks, rng = simhash.covering_masks(4), random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("limit", [1 << 14, 3])
def test_large_buckets_go_by_midpoints(spark, limit):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)} | {rng.getrandbits(64) for _ in range(10)}
    signed = {simhash._signed(f): f for f in fps}
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, limit)
    got = connected_components(links)
    groups = {r["node"]: r["root"] for r in got.collect()}
    want = components(signed, [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 4])
    for a in signed:
        for b in signed:
            assert (groups.get(a, a) == groups.get(b, b)) == (want[a] == want[b])


def test_near_dedup_of_odd_rows(odd, empty):
    stay = simhash.near_dedup(odd)
    assert stay.columns == odd.columns and sorted(r["doc_id"] for r in stay.collect()) == [1, 4, 5, 7] and simhash.near_dedup(empty).count() == 0


def test_near_dedup_against_all_pairs_of_shingles(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    base = [rng.sample(words, 100) for _ in range(12)]
    data = [" ".join(b) for b in base] + [" ".join(sorted(b)) for b in base]  # the same words in another order stay
    for b in base:
        for n in (1, 2, 3, 5):
            data.append(" ".join("new" if k in set(rng.sample(range(100), n)) else w for k, w in enumerate(b)))
    data += [" ".join([*base[0][:k], "x", *base[0][k:]]) for k in range(0, 100, 3)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in data]
    want = components(range(len(data)), [(a, b) for a in range(len(data)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_sketches_refuse_no_similar_pair(spark):
    rng = np.random.default_rng(6)
    sets = [np.zeros(0, np.uint64), *(rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (1, 5, 90, 900, 9000))]
    sets += [np.concatenate((s[int(len(s) * c) :], rng.integers(0, 1 << 64, int(len(s) * d), dtype=np.uint64))) for s in sets for c in (0, 0.05, 0.1, 0.2, 0.4) for d in (0, 0.1, 0.25, 1)]
    sets = [np.unique(s) for s in sets]
    bits = np.array([np.frombuffer(shingles.sketch(s), np.uint64) for s in sets])
    n = np.array([len(s) for s in sets])
    a, b = np.triu_indices(len(sets))
    may = shingles.may_reach(bits[a], n[a], bits[b], n[b], 0.8)
    similar = np.array([shingles.similarity(sets[i], sets[j]) >= 0.8 for i, j in zip(a, b)])
    assert may[similar].all() and not may[~similar].all()


def test_pairs_are_judged_alike_over_any_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = {k: " ".join("new" if rng.random() < k % 9 / 200 else w for w in base) for k in range(60)} | {60: "", 61: " ", 62: "a b"}
    sets = {k: shingles.shingle_set(t) for k, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    docs = spark.createDataFrame([(k, k, -k, t) for k, t in texts.items()], "cid long, k1 long, k2 long, text string")
    monkeypatch.setattr(shingles, "GROUP", 64)
    found = shingles.links(spark.createDataFrame(pairs, "u long, v long"), docs.drop("text"), docs.drop("cid"))
    want = {(a, b) for a, b in pairs if shingles.similarity(sets[a], sets[b]) >= 0.8}
    assert 10 < len(want) < len(pairs) and sorted(tuple(sorted(r)) for r in found.collect()) == sorted(want)


def test_vectors_against_all_pairs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    rng = np.random.default_rng(3)
    for k in range(60):
        v = np.array(data[k][1]) / np.linalg.norm(data[k][1])
        other = rng.standard_normal(len(v))
        other -= other @ v * v
        c = rng.uniform(0.97, 0.99)
        data.append((10_000 + k, list(map(float, 3 * (c * v + (1 - c * c) ** 0.5 * other / np.linalg.norm(other)))), data[k][2]))
    data += [(20_000, data[0][1], data[0][2]), (20_001, data[0][1], None), (20_002, None, 1), (20_003, [0.0] * 64, 1), (20_004, [float("nan")] * 64, 1), (20_005, [None] + [1.0] * 63, 1), (20_006, [], 1)]
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, k in data if v and None not in v and np.isfinite(v).all() and any(v) and k is not None}
    label = {i: k for i, _, k in data}
    ids = sorted(unit)
    near = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    count = collections.Counter(x for pair in near for x in pair)
    assert len(got) == len(data) and all(got[i]["n_links"] <= count[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * 2 * len(near)
    want = components(label, near)
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.97 * len(got) and all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert lattice.near_vectors(table.limit(0)).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)) * 2
    point = lattice.nearest_e8(x)
    assert ((point % 2 == 0).all(axis=1) | (point % 2 == 1).all(axis=1)).all() and (point.sum(axis=1) % 4 == 0).all()
    here = ((x - point / 2) ** 2).sum(axis=1)
    assert all((((x[k] - (point[k] + lattice.NEIGHBOURS) / 2) ** 2).sum(axis=1) >= here[k] - 1e-9).all() for k in range(200)) and here.max() <= 1 + 1e-9


@pytest.mark.parametrize("members", [4096, 16])
def test_large_cells_in_blocks(spark, members):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    data = [(k, list(map(float, base + 0.02 * rng.standard_normal(16))), 1) for k in range(90)]
    classes = spark.createDataFrame([(k, v, "1", 1) for k, v, _ in data], "cid long, v array<double>, label string, n long")
    hashed = lattice._hashed(classes, lattice.TABLES, lattice.BLOCKS, lattice.PROBES, lattice.SCALE)
    got = lattice.vector_links(hashed, members=members).where("v is null").groupBy("u").agg(F.sum("links").alias("n")).collect()
    assert len(got) == 90 and all(r["n"] == 89 for r in got)


# -- language and quality -----------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark, rows, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.language_report(docs).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    test = [i for i, r in got.items() if r["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i]["lang_pred"] == true[i] for i in test) >= 0.97 * len(test) and all(0 <= r["score"] <= 1 for r in got.values())
    found = [r["lang_pred"] for r in langid.language_report(odd).collect()]
    assert len(found) == len(ODD) and found.count("und") == 3 and langid.language_report(empty).count() == 0


def test_languages_of_long_texts_and_repeated_ids_keep_dictionaries(spark):
    rng = random.Random(2)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    data = [(k, text("abcde", 2000), "long") for k in range(20)] + [(None, text("vwxyz", 30), "null") for _ in range(3000)]
    data += [(7, "mnop nmop ponm", "copy")] * 3000
    model = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert set(model.languages) == {"long", "null", "copy"} and all(model.dictionaries)
    assert all(langid.Scorer(model).predict(data[k][1][:900])[0] == "long" for k in range(5))


def brute_kn(texts, order):
    """Interpolated modified Kneser-Ney of characters, straight from the definition."""
    pad = "\x02" * (order - 1)
    counts = {order: collections.Counter((pad + t)[i : i + order] for t in texts for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d[k] = [0.5, 0.75, 0.9] if not all(n[1:4]) else [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.01), j - 0.01) for j in (1, 2, 3)]

    def p(g, k):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        g = g[-k:]
        seen = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        low, total = p(g, k - 1), sum(seen.values())
        if not total:
            return low
        cut = lambda c: d[k][min(c, 3) - 1]
        return (counts[k][g] - cut(counts[k][g]) if counts[k][g] else 0) / total + sum(map(cut, seen.values())) / total * low

    return p


def test_kneser_ney_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(kneser, "COMMON", 5)
    texts = ["abab abc", "abba", "cab abab", "bcbc a"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, "abz", ""])], "doc_id long, text string, lang string")
    blocks = kneser.document_blocks(docs, 3)
    trusted = spark.createDataFrame([(k, True) for k in range(4)], "doc_id long, train boolean")
    got = {r["doc_id"]: r["mean"] for r in kneser.block_scores(blocks, kneser.model(kneser.gram_counts(blocks, trusted, 3), 3)).collect()}
    p = brute_kn(texts, 3)
    for k, t in enumerate([*texts, "abz"]):
        padded = "\x02\x02" + t
        assert got[k] == pytest.approx(-np.mean([np.log(p(padded[i : i + 3], 3)) for i in range(len(t))]), rel=1e-5)
    assert got[5] is None


def test_ngrams_are_counted_and_found_without_stable_sorts_and_searches(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abก é\U0001f600"), n)) for n in (0, 1, 3, 400, 2000, 50)] + ["abab" * 30, "\udc80b\x02"]
    wanted = collections.Counter(("\x02\x02" + t)[i : i + 3] for t in texts for i in range(len(t)))
    for segment in (1, 500, 500_000):
        monkeypatch.setattr(kneser, "SEGMENT_CHARS", segment)
        grams, counts = kneser._counted(texts, 3)
        assert len(grams) == len(wanted) and dict(zip(grams, counts.tolist())) == wanted
    top = np.array([2**64 - 1], np.uint64)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64))
        for k in (keys, np.unique(np.append(keys, top)), np.unique(keys >> np.uint64(40))):  # the last crowd in one place
            values = np.concatenate([k, rng.integers(0, 2**64 - 1, 1000, np.uint64), top, top * np.uint64(0)])
            assert (kneser._Places(k)(values) == np.searchsorted(k, values)).all()
    keys, values = np.unique(rng.integers(0, 2**64 - 1, 1 << 18, np.uint64)), rng.integers(0, 2**64 - 1, 1 << 21, np.uint64)
    places, took = kneser._Places(keys), []
    for look in (places, lambda v: np.searchsorted(keys, v)):
        began = time.process_time()
        look(values)
        took.append(time.process_time() - began)
    assert took[0] * 2 < took[1]  # about a tenth


def test_quality_keeps_clean_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"]: r["kept"] for r in kneser.quality_report(docs, labels).collect()}
    true = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    clean = [kept[i] for i, q in true.items() if q == (1, 0)]
    junk = [kept[i] for i, q in true.items() if q[0] == 0]
    assert np.mean(clean) >= 0.97 and np.mean(junk) <= 0.1
    none = labels.limit(0)
    assert kneser.quality_filter(odd, none).count() == len(ODD) and kneser.quality_report(empty, none).count() == 0
    assert kneser.quality_filter(odd, labels).columns == odd.columns


def test_thresholds_of_languages_with_few_judged_rows(spark):
    rng = random.Random(6)
    langs = [("big", 2.0, 400)] + [(f"few{k}", 3.0 + k % 5, 1 + k % 12) for k in range(60)]
    judged = spark.createDataFrame([(lang, rng.gauss(mean, 0.2)) for lang, mean, n in langs for _ in range(n)], "lang string, score double")
    thresholds, overall = kneser.language_thresholds(judged)
    got = {r["_lang"]: r["threshold"] for r in thresholds.collect()}
    own = sorted(r["score"] for r in judged.where("lang = 'big'").collect())
    assert len(got) == 61 and got["big"] in own and sum(x <= got["big"] for x in own) == 396
    clean = [rng.gauss(mean, 0.2) <= got[lang] for lang, mean, _ in langs[1:] for _ in range(200)]
    junk = [mean + 2 <= got[lang] for lang, mean, _ in langs[1:]]
    assert np.mean(clean) > 0.97 and not any(junk)
    alone, overall = kneser.language_thresholds(spark.createDataFrame([("a", 1.0)], "lang string, score double"))
    assert alone.first()["threshold"] is None and overall.first()["overall"] == 1.0


# -- the whole ------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, documents):
    docs, sizes = documents, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_dir).cache()
        assert docs.columns == documents.columns
        sizes.append(docs.count())
    assert documents.count() > sizes[0] >= sizes[1] >= sizes[2] > 0
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(got)


def test_pairs_of_a_large_bucket_are_listed_once_and_only_if_they_may_be_similar(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    data = [" ".join(base), *(" ".join(rng.sample(base, 150)) for _ in range(60))]  # the same words in other orders
    data += [" ".join("new" if i == k else w for i, w in enumerate(base)) for k in range(20, 26)] + [" ".join([*data[9].split()[:-1], "z"])]
    monkeypatch.setattr(simhash, "ALIKE", 64)
    rows = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(4), "text").alias("k2"), "text")
    classes = simhash._classes(rows)
    near, large = simhash._candidate_pairs(simhash._tables(classes))
    alone = classes.select("cid", F.col("cid").alias("root"))  # as if nothing were connected yet
    sets = {r["cid"]: shingles.shingle_set(r["text"]) for r in classes.join(rows, ["k1", "k2"]).select("cid", "text").collect()}
    more = simhash._other_pairs(classes, alone, large, 0.8).collect()
    want = {(a, b) for a in sets for b in sets if a < b and shingles.similarity(sets[a], sets[b]) >= 0.8}
    found = {(r["u"], r["v"]) for r in more}
    assert large.count() and len(more) == len(found) and want <= found | {(r["u"], r["v"]) for r in near.collect()} and len(found) < 100 < len(data) ** 2 // 2


def test_only_asked_texts_travel(spark):
    docs = spark.range(4000).select(F.xxhash64("id").alias("k1"), F.xxhash64(F.lit(4), "id").alias("k2"), F.col("id").cast("string").alias("text"))
    asked = docs.where("cast(text as long) % 40 = 7").select("k1", "k2")
    kept = shingles._asked_rows(docs, asked)
    assert kept.join(asked, ["k1", "k2"]).count() == 100 and kept.count() < 110


def test_a_family_of_large_buckets_stands_once_not_once_a_table(spark):
    base = [f"w{k}" for k in range(300)]
    data = [" ".join("new" if i == k else w for i, w in enumerate(base)) for k in range(0, 300, 10)] + ["quite another text"]
    rows = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(4), "text").alias("k2"), "text")
    classes = simhash._classes(rows)
    near, large = simhash._candidate_pairs(simhash._tables(classes))
    families = connected_components(large).collect()
    assert large.columns == ["u", "v"] and large.subtract(near).isEmpty()
    assert len(families) == len({r["node"] for r in families}) == len(data) - 1 and len({r["root"] for r in families}) == 1


def test_staged_tables_leave_no_shuffle_files_and_quality_no_blocks(spark, documents, sf_dir, tmp_path):
    from pathlib import Path

    from inkgauge.llm.staging import shared_folder, stage

    manager, folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), Path(shared_folder(spark).removeprefix("file://"))
    shuffles = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffles()
    assert stage(spark.range(1000).groupBy(F.col("id") % 7).count(), "counted").count() == 7 and not [f for f in shuffles() - before if f.endswith(".data")][1:]  # that of count() itself may be there
    there = {p.name for p in folder.iterdir()}
    assert kneser.quality_report(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")).count() == documents.count()
    assert {p.name.split("-")[0] for p in folder.iterdir() if p.name not in there} == {"trusted", "scores"}
