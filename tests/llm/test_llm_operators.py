"""Training-data operators against brute force, on the smallest tables and on awkward ones."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontaminate, html_text, media, mixing, near_dup, pii, quality, queries, repeats, token_store, warc
from tarn.llm.common import connected_components

WORD = re.compile(r"[^\x20\t-\r]+")
random.seed(7)
PROSE = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(i % 37) for i in range(120))
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


#: Nulls, empty and blank texts, a long one, repeated rows and ids, odd characters, columns whose names clash with inner ones.
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long, row long, v long, keep boolean, node string, comp int"
ROWS = [
    (1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, PROSE + " tail", None, None, None), (3, None, "en", "b", 0), (4, "", None, "b", 0), (5, " \n\t ", "en", None, 3),
    (6, LONG, "en", "a", 9), (None, PROSE, "en", "a", 1), (7, "one two", "en", "c", 2), (8, "one two", "en", "c", 2), (9, "ünï \U0001f600 x@y.example.com and +1 (555) 123-4567 then 10.0.0.1 or 4111 1111 1111 1111 <|endoftext|> don't", "en", "c", 2),
    (10, "same id", "en", "a", 1), (10, "other text under the same id", "en", "a", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 0, 0, 0, 0, True, "x", 0) for r in ROWS], AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], AWKWARD)


BENCH = [(0, " ".join(PROSE.split()[20:60])), (1, None), (2, ""), (3, "one two"), (4, "never seen at all anywhere here")]


def operators(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(10)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    path = queries.tokenizer_path()
    return {
        "pii": pii.find_personal_data, "media": media.store_and_describe, "near_dup": near_dup.near_duplicates, "repeats": repeats.remove_repeats,
        "decontaminate": lambda d: decontaminate.find_contamination(d, bench), "mix": mixing.mix, "mix_rows": mixing.mix_rows, "tokens": lambda d: token_store.encode_and_index(d, path),
        "quality": lambda d: quality.classify(d, labels, sample_rows=50), "keep_one": near_dup.keep_one, "drop": lambda d: decontaminate.drop_contaminated(d, bench),
        "html": lambda d: html_text.extract(d, page_id="doc_id", url="source", source="text"), "warc": lambda d: warc.archive_and_read(d, page_id="doc_id", url="source", html="text"),
    }


ROW_FOR_ROW = {"pii", "media", "near_dup", "repeats", "mix", "tokens", "quality", "html", "warc"}


@pytest.mark.parametrize("name", "pii media near_dup repeats decontaminate mix mix_rows tokens quality keep_one drop html warc".split())
def test_awkward_and_empty_tables(spark, awkward, empty, name):
    run = operators(spark)[name]
    got = run(awkward).collect()
    if name in ROW_FOR_ROW:
        assert len(got) == len(ROWS)
    assert run(empty).count() == 0
    if name == "near_dup":
        by = collections.defaultdict(set)
        for r in got:
            by[r.doc_id].add(r.class_id)
        assert by[1] == by[2] == {1} and by[3] == by[4] == by[5] == {3} and by[7] == by[8] == {7} and by[None] == {None} and by[10] == {10}
    if name == "decontaminate":
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 0), (None, 0), (7, 3), (8, 3)}
    if name == "keep_one":
        assert sorted(r.doc_id or -1 for r in got) == [-1, 1, 3, 6, 7, 9, 10]
    if name == "warc":
        assert sum(r.record_type == "revisit" for r in got) == 0 or all(r.payload_bytes >= 1000 for r in got if r.record_type == "revisit")
    if name == "pii":
        one = next(r for r in got if r.doc_id == 9)
        assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)


def test_pii_base_equals_plain_patterns():
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(t):
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                    continue
                yield k, m.start(), m.end()

    for _ in range(800):
        t = "".join(random.choice("ab1234567890.@+- ()_%") for _ in range(150))
        assert pii.base_spans(t) == list(plain(t))


def test_skip_links_spread_a_label():
    field = pii.Field(np.zeros((pii.N_TOKEN_FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 4.0)
    text = "call +1 (555) 123-4567 now; later 15551234567 again"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, field, 0.9)
    assert [text[a:b] for _, a, b in added] == ["15551234567"] and added[0][0] == 3


def test_audio_round_trip(spark, docs, texts):
    for r in media.store_and_describe(docs).limit(40).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        table = media.read_tensor(bytes(r.tensor))
        assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float16(), [media.PATCH, media.MELS])
        assert table["start_s"][0].as_py() == 0.0 and table.num_rows == -(-r.n_frames // media.PATCH)


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    out = media.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(out) == 16_000 * media.UP // media.DOWN and np.abs(np.fft.rfft(out)).argmax() == 440
    assert media.segments(np.array([1, 1, 9, 9, 5, 1, 1, 1], np.float32)) == [(2, 5)]


def shingled(text):
    w = WORD.findall(text)
    return collections.Counter(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def exact_jp(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_prob_jaccard_is_exact_and_estimated():
    a, b = collections.Counter({1: 3, 2: 1, 5: 2, 9: 1}), collections.Counter({1: 1, 2: 4, 7: 2, 9: 1})
    arrays = [np.array(v) for c in (a, b) for v in zip(*sorted(c.items()))]
    assert near_dup.prob_jaccard(arrays[0], arrays[1], arrays[2], arrays[3]) == pytest.approx(exact_jp(a, b))
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**62, 300, dtype=np.uint64)
    h = np.concatenate([base, base[:240], rng.integers(1, 2**62, 60, dtype=np.uint64)])
    sig = near_dup.prob_min_hash(h, np.repeat([0, 1], 300), np.ones(600), 2)
    assert abs((sig[0] == sig[1]).mean() - 2 / 3) < 0.2


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    sets = {i: shingled(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a].keys() & sets[b].keys()) > 0.5 * min(len(sets[a]), len(sets[b])) and exact_jp(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in ids}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 150: 100, 200: 100}


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a href=1>Home</a></nav><article><h1>Head &amp; line</h1><p>First <b>bold</b>er.<br>next<p>Two&nbsp;words</article><footer>f</footer>", "Head & line First bolder. next Two words"),
    ('<body><header><a href=x>Home</a></header><article><header><h1>T</h1></header><p>Body text.</p><div class="ad">Buy now</div><aside>side</aside><form>Name</form><section class="comments"><p>nice</p></section></article><div class="cookie-notice">We use cookies</div>', "T Body text."),
    ("", ""), ("<script>var x = '<p>no</p>'</script>", ""),
]


def test_html(spark, sf):
    rows = spark.createDataFrame([(i, None, h) for i, (h, _) in enumerate(PAGES)] + [(9, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(rows).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert got[i].text == text and got[i].n_chars == len(text)
    assert got[9].text == ""
    x = np.array(html_text.LABELLED, float)
    tree = html_text.grow_tree(x)
    assert np.mean([(html_text.decide(tree, r[:-1]) >= 0.5) == bool(r[-1]) for r in x]) >= 0.95


def test_html_articles_of_the_table(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        part = r.html[r.html.index("<article>") : r.html.index("</article>")]
        part = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|article)[^>]*>", "\n", part))
        assert got[r.page_id] == " ".join(html.unescape(part).split())


def test_transform_merge_equals_counting():
    for _ in range(60):
        symbol = random.choice([1, 2, 3])
        length = symbol * random.choice([2, 3, 4])
        strings = [bytes(random.choice(b"abc") for _ in range(random.randint(0, 60))) for _ in range(random.randint(1, 9))]
        count = collections.Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, mark in zip(strings, repeats.repeated_windows(strings, 40, length, symbol)):
            assert mark.tolist() == [count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


def test_windows_with_a_group_of_their_own_are_not_sorted(monkeypatch):
    """Two strings that share 60 bytes only, and two that share 300: of the first pair nothing is transformed."""
    seen, plain = [], repeats.transform
    monkeypatch.setattr(repeats, "transform", lambda symbols, *rest: seen.append(len(symbols)) or plain(symbols, *rest))
    own = [random.randbytes(4000) for _ in range(4)]
    near = [own[0] + own[3][:60] + own[1], own[1][::-1] + own[3][:60] + own[2]]
    assert not any(m.any() for m in repeats.repeated_windows(near)) and not seen
    marks = repeats.repeated_windows([own[0] + own[3][:300], own[2] + own[3][:300] + own[1]])
    assert [np.flatnonzero(m).tolist() for m in marks] == [list(range(4000, 4101))] * 2 and sum(seen) < 1000


def test_repeats_equal_brute_force(spark, docs, texts):
    periodic = spark.createDataFrame([(10**6, "ab" * 107), (10**6 + 1, "x" * 199), (10**6 + 2, "y" * 200)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionAll(periodic)
    raws = {i: t.encode() for i, t in texts.items()} | {10**6: b"ab" * 107, 10**6 + 1: b"x" * 199, 10**6 + 2: b"y" * 200}
    count = collections.Counter(r[i : i + 200] for r in raws.values() for i in range(len(r) - 199))
    for r in repeats.remove_repeats(table).collect() + repeats.remove_repeats(table, group_bytes=1500).collect():
        raw, cover = raws[r.doc_id], bytearray(len(raws[r.doc_id]))
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), sum(cover), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == len(re.findall(b"\1+", bytes(cover)))


def test_contamination_equals_brute_force(spark, sf, docs, texts):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    token = lambda t: WORD.findall(t.lower())
    grams = lambda w: collections.Counter(zip(*(w[i:] for i in range(5))))
    truth = set()
    for item in bench.collect():
        iw = token(item.text)
        ig = grams(iw)
        for i, t in texts.items():
            w = token(t)
            if ig.keys() & grams(w).keys():
                for s in range(len(w) - len(iw) + 1):
                    g = grams(w[s : s + len(iw)])
                    if sum((g & ig).values()) >= 0.8 * sum((g | ig).values()):
                        truth.add((i, item.item_id))
                        break
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == truth
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(texts) - len({i for i, _ in truth})


def test_decontamination_has_no_python(spark, sf, docs):
    plan = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def seats_one_by_one(claims, seats):
    got = [0] * len(claims)
    for _ in range(seats):
        i = max(range(len(claims)), key=lambda i: (claims[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_sainte_lague_equals_highest_quotients(spark):
    for _ in range(6):
        claims = [random.randint(1, 10 ** random.randint(1, 5)) for _ in range(random.randint(1, 25))]
        seats = random.randint(0, 200)
        rows = spark.createDataFrame(list(enumerate(claims)), "source long, claim long")
        got = mixing.sainte_lague(rows, F.lit(seats), "claim", [], [F.col("source")]).orderBy("source").collect()
        assert [r.quota for r in got] == seats_one_by_one(claims, seats)


def test_targets_fill_like_water(spark):
    sizes = {"a": 100, "b": 5, "c": 50, "d": 400, None: 20}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights, total, capped = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and weights[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 3.0 * sizes[s] if s in capped else weights[s] * level for s in sizes})


def test_mix_meets_targets_and_repeats(spark, docs, texts):
    got = mixing.mix(docs, shard_words=8000, block_words=16).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(3), shard_words=8000, block_words=16).collect())
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id])) and 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 16 * 8 and sum(r.size for r in rows) == rows[0].source_size


def test_tokens_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, at = Tokenizer.from_file(path), 0
    odd = {10**6: "don't  a² \n\n b×c", 10**6 + 1: "", 10**6 + 2: " tail \t"}
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in token_store.encode_and_index(table, path, shards=3).collect()}
    for i, t in sorted((texts | odd).items()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pieces_are_encoded_without_threads():
    """The library's threads waited for each other: more than half of the CPU time of a task, which has one core."""
    script = """
import os, sys
import pyarrow as pa
from tarn.llm import token_store
encoder = token_store.PieceEncoder(sys.argv[1])
before = len(os.listdir("/proc/self/task"))
encoder.encode_rows(pa.array([" ".join(f"w{chr(97 + i % 26)}x{i}" for i in range(9000))]), 2)
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.getcwd()}
    run = subprocess.run([sys.executable, "-c", script, queries.tokenizer_path()], env=env, capture_output=True, text=True, timeout=120, check=True)
    assert int(run.stdout) == 0


def test_token_files_are_selective(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_store.write_tokens(docs, path, queries.tokenizer_path(), shards=2)
    assert token_store.read_tokens(spark, path, 10, 19).count() == 10
    plan = token_store.read_lengths(spark, path)._jdf.queryExecution().toString()
    assert "tokens#" not in plan.split("ReadSchema")[-1]
    column = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0).column(3)
    assert "DELTA_BINARY_PACKED" in column.encodings


def test_quality_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    train = labels.filter("doc_id % 3 > 0")
    judged = quality.classify(docs, train, columns=["doc_id"]).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good, junk = [r.keep for r in judged if r.quality and not r.toxic], [r.keep for r in judged if not r.quality]
    assert np.mean(good) >= 0.97 and np.mean(junk) <= 0.1
    assert all(0 < r.path_rate < 1 for r in judged)


def test_sparse_sites_shrink(spark):
    rows = [("big", "x", 3.0)] * 200 + [("big", "x", -3.0)] * 50 + [("tiny", "y", -3.0)] + [("poor", "z", -3.0)] * 100
    sites = {r._host: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, log_odds double"), host="host", path="path").collect()}
    assert sites["poor"].path_rate < sites["tiny"].path_rate < sites["big"].path_rate


def test_warc_revisits_and_ranges(spark):
    body = "x" * 1500
    rows = spark.createDataFrame([(1, "http://a", body), (2, None, body), (5, "http://c\nd", body), (3, "http://e", "short"), (4, "http://f", "short"), (6, "http://g", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_and_read(rows).collect()}
    assert [(i, got[i].record_type, got[i].refers_to) for i in (1, 2, 5)] == [(1, "revisit", 5), (2, "revisit", 5), (5, "response", None)]
    assert all(got[i].record_type == "response" for i in (3, 4, 6)) and got[1].payload_bytes == 1500 and got[6].payload_bytes == 0
    assert got[2].payload_digest == hashlib.sha1(body.encode()).hexdigest()
    from tarn.llm.common import scratch_path

    folder = scratch_path(spark, "test")
    index = warc.write_archives(rows, folder)
    some = warc.read_records(index.filter("page_id = 3"), folder).collect()
    assert [(r.url, bytes(r.payload)) for r in some] == [("http://e", b"short")]


def test_warc_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    theirs = con.sql(queries.ORACLE_SQL["op10_warc"])
    mine = queries.op10_warc(spark, sf)
    assert sorted(theirs.fetchall()) == sorted(tuple(r) for r in mine.select(*theirs.columns).collect())


def test_pipeline_keeps_its_stages(spark, sf, docs, texts):
    import corpus_pipeline

    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.materialize(stage(spark, table, sf), "test-stage")
        assert table.columns == docs.columns, name
    assert all(texts[r.doc_id] == r.text for r in table.select("doc_id", "text").collect())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    last = corpus_pipeline.STAGES[-1][1](spark, table, sf)
    assert last.agg(F.sum("n_tokens")).first()[0] == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in table.select("text").collect())


def test_near_copies_without_their_original(spark):
    """Variants of a text that is not there: leaders link few of them, the blocks find the rest."""
    rng, rows = random.Random(5), []
    for g in range(3):
        base = [f"w{g}_{rng.randint(0, 9999)}" for _ in range(150)]
        for _ in range(50):
            words = list(base)
            for i in rng.sample(range(150), rng.randint(1, 5)):
                words[i] = f"x{rng.randint(0, 10**6)}"
            if rng.random() < 0.2:
                words += words[:6]  # some shingles twice
            rows.append((len(rows), " ".join(words)))
    sets = {i: shingled(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a].keys() & sets[b].keys() and exact_jp(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 3


def test_links_between_blocks_equal_pairwise():
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(14):
        words = list(base)
        words[rng.randint(0, 59)] = "x"
        texts.append(" ".join(words + words[:5] * rng.randint(0, 2)))
    xs = [{"text": t, "comp": i, "block": 0} for i, t in enumerate(texts)]
    every = np.arange(len(xs))
    edges = near_dup._links_between(xs, every, every, every, 0.8)
    groups = near_dup._Forest()
    for a in range(14):
        for b in range(a):
            if exact_jp(shingled(texts[a]), shingled(texts[b])) >= 0.8:
                groups.join(a, b)
    mine = near_dup._Forest()
    for a, b in edges:
        mine.join(a, b)
    tops = [[f.top(i) for i in range(14)] for f in (groups, mine)]
    assert [[t.index(x) for x in t] for t in tops][0] == [[t.index(x) for x in t] for t in tops][1]


def words_by_source(rows):
    out = collections.Counter()
    for r in rows:
        out[r.source] += len(WORD.findall(r.text))
    return out


def test_mixed_rows_meet_targets_whatever_their_length(spark):
    """Long documents of a thinned source are kept as often as short ones, and each source's words are its target."""
    rng, rows = random.Random(3), []
    for s, n, lengths in (("a", 240, (20, 900)), ("b", 30, (300, 600)), ("c", 60, (20, 900)), ("d", 90, (400, 700))):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(*lengths)), s) for i in range(n)]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    plan = mixing.mix(docs, shard_words=30_000).collect()
    got = mixing.mix_rows(docs, shard_words=30_000).collect()
    words, size, target, taken, longest = words_by_source(got), {}, {}, collections.Counter(), collections.Counter()
    for r in plan:
        size[r.source], target[r.source] = r.source_size, r.target
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    times = collections.Counter(r.doc_id for r in got)
    assert all(r.taken // r.size <= times[r.doc_id] <= -(-r.taken // r.size) for r in plan)
    for s in size:
        shards = -(-size[s] // 30_000)
        assert abs(words[s] - taken[s]) < shards * longest[s], s
        assert abs(words[s] - target[s]) < shards * (longest[s] + 64), s
    assert target["a"] < 0.5 * size["a"]
    long = [r for r in plan if r.source == "a" and r.size >= 300]
    assert abs(sum(times[r.doc_id] for r in long) / len(long) - target["a"] / size["a"]) < 0.08


def test_pipeline_words_per_source_are_the_targets(spark, sf, docs):
    import corpus_pipeline

    table = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        table = corpus_pipeline.materialize(stage(spark, table, sf), "test-words")
    before, got = words_by_source(table.collect()), words_by_source(corpus_pipeline.mix_sources(spark, table, sf).collect())
    longest = collections.Counter()
    for r in table.collect():
        longest[r.source] = max(longest[r.source], len(WORD.findall(r.text)))
    sizes = spark.createDataFrame(list(before.items()), "source string, source_size long")
    for r in mixing.targets(sizes).collect():
        assert abs(got[r.source] - r.target) < longest[r.source] + 64, r.source


def test_documents_shorter_than_an_item_equal_brute_force(spark, sf):
    """Documents that are an item without its ends, with repeated words, or with other words at an end."""
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    items += [(900, "one two three four five six"), (901, " ".join(["again and again"] * 8)), (902, "just four words here")]
    token, grams = (lambda t: WORD.findall(t.lower())), (lambda w, k: collections.Counter(zip(*(w[i:] for i in range(k)))))
    rows = []
    for _, text in items:
        w = token(text)
        for cut in range(1, min(16, len(w))):
            front = rng.randint(0, cut)
            rows += [w[:-cut], w[cut:], w[front : len(w) - cut + front], w[: -cut - 1] + ["other"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    truth = {}
    for item, text in items:
        iw = token(text)
        k = min(5, len(iw))
        for i, t in rows:
            w = token(t)
            for s in range(max(1, len(w) - len(iw) + 1)):
                a, b = grams(w[s : s + len(iw)], k), grams(iw, k)
                if a & b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    truth[i, item] = max(truth.get((i, item), 0), sum((a & b).values()) / sum((a | b).values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == pytest.approx(truth) and len(truth) > 100
    assert decontaminate.drop_contaminated(docs, bench).count() == len(rows) - len({i for i, _ in truth})


def test_a_label_reaches_all_repeats():
    """Fifty repeats: by two keys (long number), by one (seven digits, user name of an address)."""
    field = pii.Field(np.zeros((pii.N_TOKEN_FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 4.0)
    for first, again, kind in (("+1 (555) 123-4567", "15551234567", 3), ("+1-555-123-4567", "1234567", 3), ("someone@mail.example.com", "someone", 0)):
        text = f"call {first} now" + f" , {again}" * 50
        added = pii.added_spans(text, pii.base_spans(text), field, 0.9)
        assert [(k, text[a:b]) for k, a, b in added] == [(kind, again)] * 50
    assert 1 / (1 + (pii.LABELS - 1) * np.exp(-4.0)) == pytest.approx(pii.marginals(pii.Lattice([], np.zeros((2, pii.N_TOKEN_FEATURES)), np.array([4, -1]), np.zeros((2, 2)), [], [], [(0, 0), (0, 1)]), field)[1, 4], abs=1e-3)


def test_labels_cross_a_long_chain():
    """Messages go on until the last of 60 neighbours has heard of the first."""
    n = 60
    field = pii.Field(np.zeros((pii.N_TOKEN_FEATURES, pii.LABELS)), 9.0 * np.eye(pii.LABELS), 0.0)
    g = pii.Lattice([], np.zeros((n, pii.N_TOKEN_FEATURES)), np.array([2] + [-1] * (n - 1)), np.zeros((n, 2)), [(i, i + 1) for i in range(n - 1)], [], [])
    assert pii.marginals(g, field)[-1, 2] > 0.9


def test_the_last_bytes_are_in_the_features(spark):
    """Texts of all lengths modulo the hop that differ at their end only, down to the last byte."""
    rows = []
    for blocks in (1, 2, 3, 4, 5, 8, 9, 16, 17):
        text = ("many words " * 1000)[: blocks * media.BLOCK]
        rows += [text, text[:-40] + "~" * 40, text[:-1] + "\x01"]
    got = media.store_and_describe(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    for i in range(0, len(rows), 3):
        assert len({bytes(by[j].tensor) for j in (i, i + 1, i + 2)}) == 3, len(rows[i])
    for r in got:
        table = media.read_tensor(bytes(r.tensor))
        assert table["end_s"][-1].as_py() == pytest.approx(r.payload_bytes / media.RATE) and all(s.end_s <= r.payload_bytes / media.RATE for s in r.segments)


def test_sound_at_the_end_opens_a_segment():
    x = np.zeros(2 * media.FRAME + media.HOP - 1, np.float32)
    x[-100:] = 1
    mel, energy = media.log_mel(lambda a, b: np.pad(x[a:b], (0, max(0, b - len(x)))), len(x))
    assert media.segments(energy)[-1][1] == len(mel)


def test_unfinished_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_starts_and_ids_of_rows_that_share_an_id(spark):
    """Six texts under one id, two ids that are null, and words that collide in any polynomial hash modulo 2**64."""
    from tokenizers import Tokenizer

    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, f"text number {i} " + "more " * (i * i)) for i in range(6)] + [(None, "no id"), (None, "no id either"), (2, one), (3, other), (4, f"{one} {other}")]
    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    from tarn.llm.common import scratch_path

    folder = scratch_path(spark, "test-ties")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, path, shards=3)
    stored = spark.read.parquet(folder).orderBy("shard", "offset").collect()
    want, at = [], 0
    for r in stored:
        want.append((r.doc_id, at, len(r.tokens), zlib.crc32(np.array(r.tokens, "<u4").tobytes())))
        at += len(r.tokens)
    assert [r.doc_id for r in stored] == [None, None] + [1] * 6 + [2, 3, 4]
    got = token_store.token_index(spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    ids = collections.Counter((i, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 2])) for i, t in rows)
    assert ids == collections.Counter((r.doc_id, tuple(r.tokens)) for r in stored)


def test_structured_words_do_not_collide():
    from tarn.llm.common import word_hash

    text = f"{thue_morse(1024)} {thue_morse(1024, 'b', 'a')} {thue_morse(4096)} {thue_morse(4096, 'b', 'a')}".encode()
    cuts = np.cumsum([0] + [len(w) + 1 for w in text.split()])
    start, end = cuts[:-1], cuts[1:] - 1
    assert len(set(word_hash(np.frombuffer(text, np.uint8), start, end).tolist())) == 4


def test_contamination_under_shared_and_missing_ids(spark):
    """Whatever row of an id holds the item is found, in both ways of meeting the items' shingles."""
    item = " ".join(PROSE.split()[20:60])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(1, "a quite different text that is as long as it needs to be for some windows " * 3), (1, f"before {item} after"), (None, f"null {item}"), (None, "clean"), (2, f"before {item} after"), (3, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"broadcast_rows": 0}):
        got = [tuple(r) for r in decontaminate.find_contamination(docs, bench, **more).collect()]
        assert sorted(got, key=str) == sorted([(1, 0, 1.0, 1), (2, 0, 1.0, 1), (None, 0, 1.0, 1)], key=str)
        left = decontaminate.drop_contaminated(docs, bench, **more).collect()
        assert sorted((r.doc_id or -1, r.text) for r in left) == sorted((i or -1, t) for i, t in rows if item not in t)


def test_simhash_recall_near_the_threshold(spark, sf):
    """Copies of items with words changed in all ways that leave a similarity from 0.8 to 0.85, as windows of item size."""
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    token, grams = (lambda t: WORD.findall(t.lower())), (lambda w: collections.Counter(zip(*(w[i:] for i in range(5)))))
    truth, rows = set(), []
    for item, text in items:
        w = token(text)
        for _ in range(60):
            v = list(w)
            for i in rng.sample(range(len(w)), rng.randint(1, 3)):
                v[rng.choice([i, 0, len(w) - 1])] = f"x{rng.randint(0, 10**6)}"
            a, b = grams(v), grams(w)
            if 0.8 <= sum((a & b).values()) / sum((a | b).values()) <= 0.85:
                rows.append((len(rows), " ".join(["lead"] * rng.randint(0, 40) + v + ["tail"] * 40)))
                truth.add((len(rows) - 1, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = len(truth & got) / len(truth)
    print(f"recall of {len(truth)} pairs: {recall}")
    assert len(truth) > 150 and recall == 1.0


def test_mixed_rows_with_shared_and_missing_ids(spark):
    """Words by source are those that the plan takes, to less than a document, for rows without an id and rows that share one."""
    rng, rows = random.Random(8), []
    for s, n, ids in (("a", 200, lambda i: None), ("b", 30, lambda i: 7), ("c", 60, lambda i: 1000 + i // 2)):
        rows += [(ids(i), " ".join([f"{s}{i}"] * rng.randint(20, 400)), s, 1, i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, _mix_row int")
    plan, got = mixing.mix(docs).collect(), mixing.mix_rows(docs).collect()
    taken, copies = collections.Counter(), collections.Counter(r.text for r in got)
    for r in plan:
        taken[r.source] += r.taken
    for s, words in words_by_source(got).items():
        assert abs(words - taken[s]) < 400, s
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "row", "_mix_row"}
    for (i, size), held in {k: [r for r in plan if (r.doc_id, r.size) == k] for k in {(r.doc_id, r.size) for r in plan}}.items():
        texts = [t for d, t, *_ in rows if d == i and len(t.split()) == size]
        assert sum(r.taken // r.size for r in held) <= sum(copies[t] for t in texts) <= sum(-(-r.taken // r.size) for r in held)


def test_long_digit_runs_and_fitted_field(spark):
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.{zeros}.{zeros}1.{zeros}255") == [(1, 0, 20_007)] and pii.base_spans(f"1.2.3.{zeros}256") == []
    # planted repeats: numbers written otherwise and user names of addresses; other numbers and words stay
    rng, rows, truth = random.Random(6), [], {}
    filler = "the quick brown fox jumps over a lazy dog while counting sheep".split()
    for i in range(300):
        words = [rng.choice(filler) for _ in range(40)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(40)] = str(rng.choice([7, 2024, 19, 305]))
        d, planted = "".join(rng.choice("23456789") for _ in range(10)), None
        if i % 3 == 0:
            words[3], words[30] = f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", (planted := f"1{d}")
        elif i % 3 == 1:
            words[3], words[30] = f"person{d[:4]}@mail.example.com", (planted := f"person{d[:4]}")
        else:
            words[3] = f"person{d[:4]}@mail.example.com and +1 ({d[:3]}) {d[3:6]}-{d[6:]} at 10.0.{i % 250}.7"
        rows.append((i, " ".join(words)))
        truth[i] = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hit = wrong = 0
    for r in pii.find_personal_data(docs).collect():
        base, every = set(r.base.split(",")), set(r.spans.split(","))
        text = rows[r.doc_id][1]
        added = [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in every - base)]
        assert r.n_added == len(added) and r.n_found == len(every)
        hit += truth[r.doc_id] in added
        wrong += len([x for x in added if x != truth[r.doc_id]])
    planted = sum(t is not None for t in truth.values())
    print(f"added spans: recall {hit / planted}, precision {hit / (hit + wrong)}")
    assert hit >= 0.95 * planted and wrong <= 0.05 * hit


def test_secrets_are_spans_of_their_own():
    text = 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" and a-long-hyphenated-word-without-any-number'
    assert [(k, text[a:b]) for k, a, b in pii.secret_spans(text)] == [(4, "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde")]


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice("some plain words that stand in a row and say little of note today".split()) for _ in range(n))


def test_html_pages_without_an_article_and_misleading_names():
    tree, links = html_text.grow_tree(np.array(html_text.LABELLED, float)), "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(6))
    p, q, long = prose(70, 1), prose(45, 2), prose(130, 3)
    cases = [
        (f"<body><div><ul>{links}</ul></div><h1>A title</h1><div><p>{p}</p><p>{q}</p></div><div><ul>{links}</ul></div></body>", f"A title {p} {q}"),
        (f"<body><div class='site-header'>Site name</div><div id=main><h2>A title</h2><p>{p}<p>{q}</div><div class='cookie-banner'>We use cookies here</div>", f"A title {p} {q}"),
        (f"<div class='ad-free article'>{p}</div>", p),
        (f"<article><p>{p}</p><div class='social-history'>{q}</div></article>", f"{p} {q}"),
        (f"<body><ul>{links}</ul><div class='content search-results'>{prose(80, 4)}</div></body>", prose(80, 4)),
        (f"<article><p>{p}</p><div class='promo'>{long}</div><p>{q}</p></article>", f"{p} {q}"),
        (f"<article><p>{p}</p><div class='ad-slot'>Buy now</div><p>{q}</p><div class='comments'><p>{prose(30, 5)}</p><p>{prose(140, 6)}</p><p>{prose(20, 7)}</p></div></article>", f"{p} {q}"),
        (f"<header>Site</header><nav>{links}</nav><main><p>{p}</p></main><aside>{q}</aside><form>{q}</form><footer>{q}</footer>", p),
        ("1 < 2 and 3 &#0000000065; &#99999999999; " + p, f"1 < 2 and 3 A � {p}"),
    ]
    for page, text in cases:
        assert html_text.main_text(page, tree) == text, page[:80]


@pytest.mark.parametrize("n", [3, 108, 126, 150, 300, 1000])
@pytest.mark.parametrize("name", ["comment", "comments", "advert", "cookie-notice", "notice", "sidebar", "ad"])
def test_html_named_blocks_of_any_length_are_left_out(name, n):
    tree, p, q, aside = html_text.grown(html_text.LABELLED), prose(90, 1), prose(40, 2), prose(n, 3)
    for body in (f"<article><p>{p}</p><p>{q}</p></article><div class='{name}'>{aside}</div>", f"<article><p>{p}</p><div class='{name}'><p>{aside}</p></div><p>{q}</p></article>", f"<div class='{name}'>{aside}</div><article><p>{p}</p><p>{q}</p></article>",
                 f"<div><p>{p}</p><p>{q}</p></div><section id={name}><p>{aside}</p><p>{aside}</p></section>"):
        assert html_text.main_text(f"<html><body>{body}</body></html>", tree) == f"{p} {q}", body[:60]


def test_html_left_out_end_tags_and_nested_articles():
    tree, p, q, r = html_text.grown(html_text.LABELLED), prose(90, 1), prose(40, 2), prose(200, 3)
    menu = "<ul>" + "".join(f"<li><a href=/{i}>go {i}</a>" for i in range(5)) + "</ul>"
    cases = [
        (f"<html><head><title>x</title><body><article><p>{p}<p>{q}</article></body></html>", f"{p} {q}"),
        (f"<html><head><meta charset=utf-8><title>x</title><style>p {{}}</style><article><p>{p}<p>{q}</article>", f"{p} {q}"),
        (f"<head><title>x</title><p>{p}</p><p>{q}", f"{p} {q}"),
        (f"<body><nav>{menu}<article><p>{p}<p>{q}</article>", f"{p} {q}"),
        (f"<body><form action=/><nav>{menu}</nav><main><p>{p}</p><p>{q}</p></main></form>", f"{p} {q}"),
        (f"<article><h1>A title</h1><p>{p}<p>{q}<section><article><h3>Name</h3><p>{r}</p></article><article><p>{q}</p></article></section></article>", f"A title {p} {q}"),
        (f"<article><h1>All news</h1><article><p>{p}</p></article><article><p>{q}</p></article></article>", f"All news {p} {q}"),
        (f"<aside><article><p>{r}</p></article></aside><article><p>{p}</p><p>{q}</p></article>", f"{p} {q}"),
        (f"<article><p>{p}</p><p>{q}</p></article><div>© 2020 A Name. All rights reserved.</div>", f"{p} {q}"),
        (f"<div><p>{p}</p><p>{q}</p></div><div>Copyright 2020 A Name</div>", f"{p} {q}"),
        (f"<body class='page sidebar'><div class='sidebar'>{r}</div><div class='section'><main><p>{p}<p>{q}</main></div>", f"{p} {q}"),
    ]
    for page, text in cases:
        assert html_text.main_text(page, tree) == text, page[:90]


def test_html_blocks_of_held_out_pages():
    """Precision and recall on pages that the tree has not seen; neighbours have a say in it."""
    tree, made = html_text.grown(html_text.LABELLED), html_text.LabelledPages(2024)
    x = np.array(html_text.labelled_rows([made.page() for _ in range(400)]))
    got, want = np.array([html_text.decide(tree, r[:-1]) >= 0.5 for r in x]), x[:, -1] > 0
    assert (got & want).sum() / got.sum() >= 0.95 and (got & want).sum() / want.sum() >= 0.95

    def used(t):
        return set() if isinstance(t, float) else {html_text.FEATURES[t[0]]} | used(t[2]) | used(t[3])

    assert used(tree) >= {"words", "link_density", "words_before", "density_before", "words_after", "density_after"}


@pytest.mark.parametrize("page", ["<b>" * 120_000 + "</i>" * 120_000, "<a " * 330_000, "<a \"'" * 200_000, "<p>" * 160_000 + "</div>" * 80_000, "&#" + "9" * 10**6 + ";", "<!--" * 250_000, "<" * 10**6, "<a href=\"x>" * 90_001, "<ul><li>" * 80_000 + "</p>" * 80_000])
def test_hostile_pages_take_linear_time(page):
    import time

    tree, began = html_text.grow_tree(np.array(html_text.LABELLED, float)), time.process_time()
    html_text.main_text(page, tree)
    assert time.process_time() - began < 3


def test_large_buckets_are_split_without_loss(spark):
    """One large group of near copies of a text and of its copies, all in common buckets, against all pairs by brute force."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3, 4, 6, 9])):
            words[j] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingled(t) for i, t in rows}
    number = {s: n for n, s in enumerate(sorted(set().union(*sets.values())))}
    arrays = {i: [np.array(v) for v in zip(*sorted((number[s], n) for s, n in c.items()))] for i, c in sets.items()}
    parent, pairs = {i: i for i in sets}, []

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            if near_dup.prob_jaccard(*arrays[a], *arrays[b]) >= 0.8:
                pairs.append((a, b))
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (near_dup.BLOCK, 40):
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs, block=block).collect()}
        assert got == {i: find(i) for i in sets}, block
        assert np.mean([got[a] == got[b] for a, b in pairs]) == 1.0
    assert 1 < len(set(got.values())) < 130


def test_near_dup_candidates_do_not_depend_on_the_size_of_a_bucket(spark):
    """Equal signatures that share one band only join their components, whether their bucket is one block or many."""
    sig = bytes(4 * near_dup.M)
    sigs = spark.createDataFrame([(n, sig, [7, 100 + n]) for n in range(1, 9)], "node long, sig binary, bands array<long>")
    comps = spark.createDataFrame([(n, 1) for n in range(1, 6)], "node long, comp long")
    members = sigs.select(F.lit(7).cast("long").alias("bucket"), "node")
    for block in (near_dup.BLOCK, 3, 2, 1):
        edges, _ = near_dup._families(members, sigs, comps, block, near_dup.AGREE)
        forest = near_dup._Forest()
        for e in edges.collect():
            forest.join(e.a, e.b)
        assert {forest.top(n) for n in (1, 6, 7, 8)} == {1}, block


def test_quality_of_repeated_ids_and_labels(spark):
    """Labels that contradict each other count as the strictest, and documents that share a labelled id as one, in any order."""
    good, junk = "the house stands near the old river and people walk there", "BUY || NOW ||| $$$ >>> CLICK ### !!!"
    rows = [(i, good + f" {i}" if i % 2 else junk + f" {i}") for i in range(60)]
    marks = [(i, i % 2, 0) for i in range(60)]
    shared = rows + [(1, "zz " + junk)] * 300 + [(None, junk)] * 20 + [(3, None)] * 2
    doubled = marks + [(5, 0, 0), (7, 1, 1), (None, 1, 0), (9, None, 1)] * 3
    make = lambda d, m: quality.fit(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(m, "doc_id long, quality int, toxic int"))
    plain = [(i, "" if i == 3 else t) for i, t in rows]  # the empty text is the smallest of id 3
    strict = [(i, 0 if i == 5 else q, 1 if i == 7 else t) for i, q, t in marks]
    want = make(plain, strict)
    for d, m in ((shared, doubled), (shared[::-1], doubled[::-1])):
        got = make(d, m)
        assert np.allclose(got.weights, want.weights) and np.allclose(got.mean, want.mean) and got.prior == want.prior


def test_quality_equals_brute_force(spark, sf):
    """Posteriors and decisions from each document's own log-odds, by plain sums over hosts and paths."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels, columns=["doc_id", "source", "lang"]).collect()
    p = {r.doc_id: 1 / (1 + np.exp(-r.log_odds)) for r in got}
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        hosts[r.source].append(p[r.doc_id])
        paths[r.source, r.lang].append(p[r.doc_id])
    rate = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups, centre):
        n = sum(map(len, groups.values()))
        spread = sum(len(g) * (np.mean(g) - centre(k)) ** 2 for k, g in groups.items())
        var = sum(len(g) * centre(k) * (1 - centre(k)) for k, g in groups.items())
        between = min(max((spread / n - var / n / (n / len(groups))) / (var / n), 1e-4), 0.95)
        return 1 / between - 1

    k = strength(hosts, lambda _: rate)
    host = {h: (sum(g) + k * rate) / (len(g) + k) for h, g in hosts.items()}
    k = strength(paths, lambda key: host[key[0]])
    path = {key: (sum(g) + k * host[key[0]]) / (len(g) + k) for key, g in paths.items()}
    logit = lambda q: np.log(q / (1 - q))
    for r in got:
        assert r.host_rate == pytest.approx(host[r.source]) and r.path_rate == pytest.approx(path[r.source, r.lang])
        odds = r.log_odds - logit(rate) + logit(path[r.source, r.lang])
        assert r.posterior == pytest.approx(1 / (1 + np.exp(-odds))) and r.keep == (odds >= 0)


def test_log_mel_equals_brute_force():
    """Frame by frame, with a plain Fourier sum, over several chunks of samples."""
    rng = np.random.default_rng(3)
    payload = rng.integers(0, 256, 2500, dtype=np.uint8)
    x = (payload.astype(float) - 128) / 128
    taps, up, down = media._phases().astype(float), media.UP, media.DOWN
    padded = np.concatenate([np.zeros(media.TAPS - 1), x, np.zeros(4 * media.FRAME)])
    n_out = -(-len(x) * up // down)
    y = np.array([taps[m * down % up] @ padded[m * down // up :][: media.TAPS] for m in range(n_out + media.FRAME)])
    window, bank = media._bank()
    mel, energy = media.log_mel(lambda a, b: media.resample(payload, a, b - a), n_out)
    assert len(mel) == -(-n_out // media.HOP)
    t = np.arange(media.FRAME)
    for i in range(len(mel)):
        frame = y[i * media.HOP :][: media.FRAME] * window
        power = np.array([abs((frame * np.exp(-2j * np.pi * k * t / media.FRAME)).sum()) ** 2 for k in range(media.FRAME // 2 + 1)]) / media.FRAME
        assert mel[i] == pytest.approx(np.log(np.maximum(power @ bank, np.exp(media.FLOOR))), abs=2e-3) and energy[i] == pytest.approx((frame**2).mean(), rel=1e-3)
    chunk = media.CHUNK
    whole = media.resample(rng.integers(0, 256, 2 * chunk, dtype=np.uint8).astype(np.float32))
    assert chunk % media.UP == 0 and (chunk // media.HOP * media.HOP) % media.UP == 0 and len(whole) == 2 * chunk * up // down


def brute_classes(texts):
    """Smallest id of each near-duplicate class, by all pairs."""
    sets = {i: shingled(t) for i, t in texts.items()}
    number = {s: n for n, s in enumerate(sorted(set().union(*sets.values())))}
    arrays = {i: [np.array(v, np.int64) for v in zip(*sorted((number[s], n) for s, n in c.items()))] for i, c in sets.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (not arrays[a] and not arrays[b]) or (arrays[a] and arrays[b] and near_dup.prob_jaccard(*arrays[a], *arrays[b]) >= 0.8):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def brute_contaminated(texts, items):
    token, grams = (lambda t: WORD.findall(t.lower())), (lambda w, k: collections.Counter(zip(*(w[i:] for i in range(k)))))
    words = {i: token(t) for i, t in texts.items()}
    held, out = {i: set(grams(w, 5)) for i, w in words.items()}, set()
    for text in items:
        iw = token(text)
        k = min(5, len(iw))
        ig = grams(iw, k)
        for i, w in words.items():
            if k < 5 or ig.keys() & held[i]:
                for s in range(max(1, len(w) - len(iw) + 1)):
                    g = grams(w[s : s + len(iw)], k)
                    if g & ig and sum((g & ig).values()) >= 0.8 * sum((g | ig).values()):
                        out.add(i)
                        break
    return out


def test_pipeline_keeps_the_ids_that_brute_force_keeps(spark, sf, docs):
    import corpus_pipeline

    table, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        table = corpus_pipeline.materialize(stage(spark, table, sf), "test-ids")
        kept.append({r.doc_id: r.text for r in table.select("doc_id", "text").collect()})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert kept[0].keys() == {r.doc_id for r in quality.classify(docs, labels).filter("keep").select("doc_id").collect()}
    assert kept[1].keys() == set(brute_classes(kept[0]).values())
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert kept[2].keys() == kept[1].keys() - brute_contaminated(kept[1], items)
    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, table, sf).collect())
    plan = {r.doc_id: r for r in mixing.mix(table).collect()}
    assert mixed.keys() <= kept[2].keys() and all(r.taken // r.size <= mixed[i] <= -(-r.taken // r.size) for i, r in plan.items() if r.size)


def test_scratch_tables_go_when_nothing_reads_them(spark, docs):
    from tarn.llm.common import discard, materialize, recording

    with recording([]) as made:
        a, b = materialize(docs.limit(3), "a"), materialize(docs.limit(4), "b")
    discard(made, unless=b)
    assert len(made) == 1 and b.count() == 4
    with pytest.raises(Exception):
        a.count()


def test_stages_on_awkward_and_empty_tables(spark, sf, awkward, empty):
    """Every stage keeps all columns and whole rows, whatever the ids, nulls and names of other columns are."""
    import corpus_pipeline
    from tarn.llm.common import materialize

    texts = collections.Counter(r[1] for r in ROWS)
    for name, stage in corpus_pipeline.STAGES:
        for table in (awkward, empty):
            rows = materialize(stage(spark, materialize(table, "awkward"), sf), "awkward-out").collect()
            if table is empty:
                assert rows == []
            elif name == "token output":
                assert len(rows) == len(ROWS)
            else:
                assert rows and list(rows[0].asDict()) == awkward.columns, name
                kept = collections.Counter(r.text for r in rows)
                if name == "MinHash near-dedup":
                    assert kept[LONG] == 1 and sorted(r.doc_id or -1 for r in rows) == [-1, 1, 3, 6, 7, 9, 10]
                elif name == "benchmark decontamination":
                    assert kept == texts  # no row holds an item of the benchmark
                elif name == "mixing sources":
                    assert set(kept) <= set(texts) and all(n <= 3 * texts[t] for t, n in kept.items()) and not {None, ""} & set(kept)
                else:
                    assert kept <= texts and kept[LONG] <= 1


def test_items_without_an_id_are_sought(spark):
    """Items under no id or under one id are each found, dropped, and listed by what id they have."""
    rng = random.Random(3)
    items = [" ".join(f"i{rng.randint(0, 999)}" for _ in range(30)) for _ in range(3)]
    bench = spark.createDataFrame([(None, items[0]), (5, items[1]), (5, items[2]), (6, items[2])], "item_id long, text string")
    rows = [(1, f"before {items[0]} after"), (2, items[1] + " x"), (3, "y " + items[2]), (4, "clean words only here and there")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.similarity) for r in decontaminate.find_contamination(table, bench).collect())
    assert sorted(map(str, got)) == sorted(map(str, [(1, None, 1.0), (2, 5, 1.0), (3, 5, 1.0), (3, 6, 1.0)]))
    assert [r.doc_id for r in decontaminate.drop_contaminated(table, bench).collect()] == [4]


def test_blocks_are_selective(spark):
    """Of unrelated windows and items far from all pairs meet in a block; all within the radius do."""
    rng = np.random.default_rng(4)
    x, y = (spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(rng.integers(-(2**63), 2**63 - 1, 300))], "id int, fp long") for _ in range(2))
    at = lambda value: F.explode(F.array(*[F.struct(F.lit(b).alias("b"), value(F.col("fp"), b).alias("v")) for b in range(decontaminate.BLOCKS)])).alias("e")
    asked = x.select("id", at(decontaminate._block)).select("id", "e.b", "e.v")
    filed = y.select(F.col("id").alias("item"), at(decontaminate._near_values)).select("item", "e.b", F.explode("e.v").alias("v"))
    pairs = asked.join(filed, ["b", "v"]).select("id", "item").distinct().count()
    assert pairs < 0.3 * 300 * 300
    for bits in (1, 9, decontaminate.RADIUS):
        turned = [(i, int(np.int64(r.fp) ^ np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.choice(64, bits, replace=False).astype(np.int64))))) for i, r in enumerate(x.collect())]
        near = spark.createDataFrame(turned, "id int, fp long").select(F.col("id").alias("item"), at(decontaminate._near_values)).select("item", "e.b", F.explode("e.v").alias("v"))
        assert asked.join(near, ["b", "v"]).filter("id = item").select("id").distinct().count() == 300


def test_equal_rows_without_ids_are_spread(spark):
    """A thousand equal rows without an id: shards keep their size, all are linear, reruns agree."""
    text = " ".join(f"w{i % 50}" for i in range(1000))
    rows = [(None, text, "a")] * 400 + [(None, f"{text} {i}", "a") for i in range(200)] + [(i, text, "a") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    shards = mixing._taken(table, shard_words=40_000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(shards) == 21 and max(r.n for r in shards) < 80_000
    once, again = (sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(table.repartition(n), shard_words=40_000).collect()) for n in (3, 6))
    assert once == again
    found = repeats.remove_repeats(table.limit(0).unionAll(spark.createDataFrame([(None, text, "a")] * 1000, table.schema))).collect()
    assert len(found) == 1000 and {(r.n_bytes, r.n_removed) for r in found} == {(len(text), len(text))}
