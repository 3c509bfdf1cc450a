"""The corpus operators against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.llm import common, decontam, exact, html, jaccard, langid, mixing, quality, suffix, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, digest int, label string, key int, `n` int"
LONG = "lorem ipsum dolor " * 20_000


def make(spark, rows, parts=3):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, None, None, "x", 1, "y", 2, 3) for i, t, lang in rows], SCHEMA).repartition(parts)


def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, one language unknown."""
    return make(spark, [(1, None, None), (2, "", "en"), (3, " \n\t", "en"), (4, LONG, "en"), (5, LONG, "en"), (5, LONG, "en"), (6, "short", None), (7, "ünïcödé 漢字 𠀀 text", "de"), (None, "no id here at all", "en"), (8, "12 34 -- !!", "en")])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng, n, vocabulary=None):
    vocabulary = vocabulary or [a + b for a in "bcdfgklm" for b in ("a", "e", "ing", "or", "ust")]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage = words(rng, 40)
    base = words(rng, 120)
    out = []
    for i in range(n):
        kind = i % 6
        text = words(rng, rng.randint(1, 90))
        if kind == 1:
            text = base
        elif kind == 2:
            w = base.split()
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = text + "\n" + passage + " " + words(rng, 5)
        elif kind == 4:
            text = words(rng, rng.randint(1, 4))
        out.append((i * 7 % 61, text, ["en", "de"][i % 2]))
    return out


# exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        done = False
        for m in members:
            kept = m == best and not done
            done |= kept
            out.append((m[0], best[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"salt_entries": 1}, {"salt_entries": 2}, {"held_bytes": 10}])
def test_exact(spark, options):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a b", "ab", " a\tb ", "c", "", None, "ab\n"])) for i in range(80)]
    df = make(spark, [(i, t, None) for i, t in rows], 8)
    assert sorted(map(tuple, exact.exact_dedup(df, **options).collect()), key=str) == brute_exact(rows)


def test_exact_odd(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    assert sorted(map(tuple, exact.exact_dedup(odd(spark)).collect()), key=str) == brute_exact(rows)
    assert exact.exact_dedup(empty(spark)).collect() == []


def test_unique_documents_tell_rows_apart(spark, tmp_path):
    rows = [(1, "a b c"), (None, "a b c"), (None, "x"), (5, "other"), (3, "same text"), (5, "same text"), (5, "other"), (6, None), (7, " ")]
    want = [(None, "x"), (1, "a b c"), (3, "same text"), (5, "other"), (7, " ")]
    docs = spark.createDataFrame([(i, t, "r", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row string, kept int").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    for df in (docs, spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "docs")).where("kept >= 0")):
        got = exact.unique_documents(df)
        assert got.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_tables_go_with_their_readers(spark):
    import gc
    import os

    def settle():
        for _ in range(2):
            gc.collect()
            spark._jvm.System.gc()
        common.sweep(spark)

    table = common.written(spark.range(5), "kept")
    path = table.inputFiles()[0].removeprefix("file://")
    held = table.where("id > 1").selectExpr("id + 1 AS x")
    del table
    settle()
    assert os.path.exists(path) and held.count() == 3
    del held
    settle()
    settle()
    assert not os.path.exists(path)


# URL filters


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    pages = [(1, "http://a.example.com/en/1"), (2, "https://WWW.Example.com/en/x?q#f"), (3, "http://x.net/es/"), (4, "http://x.net/ES/"), (5, None), (6, "no scheme.com/en/"), (7, "http://com"), (8, "ftp://notexample.com/en/"), (9, "a://b://c.com/x"), (9, "a://b://c.com/x"), (10, "http://example.com?u=/en/")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, verdict int")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_filter(spark, df, rules).collect() if r["page_id"] != 5 and r["rule"])
    assert got == [(1, "a.example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (3, "x.net", "/es/", "net/es/", "block"), (8, "notexample.com", "/en/", "com/", "allow")]
    rest = {r["page_id"]: (r["host"], r["path"], r["verdict"]) for r in urls.url_filter(spark, df, rules, "block").collect() if not r["rule"]}
    assert rest[5] == rest[6] == ("", "", "block") and rest[7] == ("com", "", "block") and rest[9][0] == "b:" and rest[10] == ("example.com", "", "block")
    assert urls.url_filter(spark, df, []).where("rule is null").count() == len(pages)
    assert urls.url_filter(spark, df.limit(0), rules).collect() == []


def test_urls_odd(spark):
    rules = [("block", "example.com", "/en/"), ("allow", "com", "/")]
    dots, deep = "." * 300_000, "a." * 100_000 + "example.com"
    rows = [(1, f"http://{dots}/x", "h"), (2, f"http://{deep}/en/" + "y" * 300_000, "h"), (None, None, "h"), (3, "", "h"), (3, "", "h"), (4, "http://", "h"), (5, "http:///en/", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(((r["page_id"], len(r["host"]), r["rule"], r["verdict"]) for r in urls.url_filter(spark, df, rules).collect()), key=str)
    assert got == sorted([(1, 300_000, None, "allow"), (2, len(deep), "example.com/en/", "block"), (None, 0, None, "allow"), (3, 0, None, "allow"), (3, 0, None, "allow"), (4, 0, None, "allow"), (5, 0, None, "allow")], key=str)


def test_url_candidates_against_all_suffixes(tmp_path):
    rng = random.Random(2)
    rules = [("block", ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), "/" + rng.choice(["", "x", "xy/"])) for _ in range(30)]
    (tmp_path / "index").write_bytes(urls.Index.pack(rules))
    index, strings = urls.Index(str(tmp_path / "index")), {h + p for _, h, p in rules}
    for _ in range(300):
        host, path = ".".join(rng.choice("abc") for _ in range(rng.randint(1, 5))), "/" + rng.choice(["", "x", "xy", "xy/z"])
        fits = [(len(h + p), len(h), h + p) for _, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert next((c for c in index.candidates(host, path) if c in strings), None) == (max(fits)[2] if fits else None)


def test_url_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "key_of", lambda rule: 7)
    (tmp_path / "index").write_bytes(urls.Index.pack([("allow", "a", "/x"), ("block", "b", "/"), ("block", "c", "/yy")]))
    index = urls.Index(str(tmp_path / "index"))
    found = index.find(["b/", "a/x", "zz", "c/yy"])
    assert [-1 if f < 0 else int(index.codes[f]) for f in found] == [1, 0, -1, 1]


# decontamination


def brute_hits(text, items, n):
    find = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w = find(text)
    hit, got = set(), set()
    for item, t in items:
        u = find(t)
        for k in range(max(1, len(u) - n + 1)) if u else ():
            part = u[k : k + n]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    got.add(str(item))
    return len(w), sorted(hit), sorted(got)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "PORTION", 1)
    items = [(1, "One two THREE four five six"), (2, "alpha-beta"), (3, None), (4, "!!"), (5, "two three four five"), (5, "two three four five"), (6, "é ü 漢字")]
    texts = [(1, "zero one, two; three four FIVE six seven"), (2, "ALPHA beta gamma alpha\nbeta"), (3, None), (4, ""), (5, "one two three"), (6, "x é Ü é ü 漢字 y"), (6, "x é Ü é ü 漢字 y"), (7, "alphabeta alpha"), (None, "two three four five")]
    docs = make(spark, [(i, t, None) for i, t in texts])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(spark, docs, bench, n=4, shard_bytes=block).collect()
    assert len(got) == len(texts)
    want = {i: brute_hits(t, items, 4) for i, t in texts}
    plain = dict(texts)
    for r in got:
        n, hit, own = want[r["doc_id"]]
        assert (r["n_words"], sorted(x for s in r["spans"] for x in range(s["first"], s["behind"])), r["items"]) == (n, hit, own)
        for s in r["spans"]:
            inner = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", plain[r["doc_id"]][s["start"] : s["stop"]])
            assert len(inner) == s["behind"] - s["first"]
    assert decontam.contamination(spark, empty(spark), bench).collect() == []
    assert decontam.contamination(spark, docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    clean = decontam.keep_clean(spark, docs, bench, n=4, shard_bytes=block)
    assert clean.columns == docs.columns
    assert sorted((r["text"] for r in clean.collect()), key=str) == sorted((t for _, t in texts if not brute_hits(t, items, 4)[1]), key=str)
    with pytest.raises(ValueError, match="most_bytes"):
        decontam.contamination(spark, docs, bench, most_bytes=5)


def test_contamination_odd(spark):
    items = spark.createDataFrame([(None, "one two three four"), (7, "one two three four"), (None, None)], "item_id long, text string")
    docs = make(spark, [(1, "ONE two, three four", None), (2, "x " * 200_000 + "one two three four", None), (3, "y" * 300_000, None)])
    got = {r["doc_id"]: r for r in decontam.contamination(spark, docs, items, n=4).collect()}
    assert got[1]["items"] == ["7"] and got[1]["spans"][0]["behind"] == 4
    assert got[2]["n_words"] == 200_004 and got[2]["spans"][0]["first"] == 200_000 and got[2]["spans"][0]["start"] == 400_000
    assert got[3]["n_words"] == 1 and not got[3]["spans"]


# n-gram Jaccard join


def brute_components(rows, percent=85, width=4):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(s), least[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("options", [{}, {"often": 1}, {"often": 1, "pairs_up_to": 60}, {"block_rows": 2, "block_from": 3, "cell_rows": 4, "family_rows": 5, "often": 0}])
def test_components(spark, options):
    rows = [(i, t) for i, t, _ in corpus()]
    df = make(spark, [(i, t, None) for i, t in rows], 5)
    got = sorted(map(tuple, jaccard.similarity_components(spark, df, **options).collect()))
    assert got == brute_components(rows)


def test_components_over_more_partitions_than_cores(spark):
    rows = [(i, t) for i, t, _ in corpus(4, 60)]
    df = make(spark, [(i, t, None) for i, t in rows], 40)
    assert sorted(map(tuple, jaccard.similarity_components(spark, df).collect())) == brute_components(rows)


def test_components_chain(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(100 - k, " ".join(base[k * 2 : k * 2 + 30])) for k in range(14)]  # each is near its neighbours only
    got = sorted(map(tuple, jaccard.similarity_components(spark, make(spark, [(i, t, None) for i, t in rows]), width=1).collect()))
    assert got == brute_components(rows, width=1)


def test_components_odd(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(spark, odd(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (5, 3, 4), (6, 1, 6), (None, 2, None)} <= got


def test_a_row_without_id_links_others(spark):
    base = [f"w{k}" for k in range(60)]
    chain = [" ".join(base[k * 2 : k * 2 + 40]) for k in range(3)]  # the first and the last are no near copies
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (2, "another text with this id"), (None, "a row of its own")]
    df = make(spark, [(i, t, None) for i, t in rows])
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similarity_components(spark, df, width=1).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (2, 2), (None, None)], key=str)
    kept = jaccard.distinct_documents(spark, df, 85, 1)
    assert kept.columns == df.columns and sorted(r["text"] for r in kept.collect()) == sorted([chain[0], "another text with this id", "a row of its own"])


def test_shingler_against_plain_words():
    rng = random.Random(3)
    texts = [rng.choice([None, "", " ", "\t\n"]) if rng.random() < 0.2 else "".join(rng.choice("aAbB\x0b\x85 é漢 \n\t  cx") for _ in range(rng.randint(0, 120))) for _ in range(200)]
    texts += ["x" * 5000, "y " * 3000, "z" * 700 + " " + "z" * 900]

    def plain(t, width):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(width, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    for block in (8, 64, 1 << 16):
        for width in (1, 4):
            got = jaccard.Shingler(width, block).sets_of(pa.array(texts, pa.string()))
            want = [plain(t, width) for t in texts]
            assert [len(x) for x in got] == [len(x) for x in want]
            assert len(set(np.concatenate(got).tolist())) == len(set().union(*want))


def test_odd_components_of_an_empty_table(spark):
    assert jaccard.similarity_components(spark, empty(spark)).collect() == []


def test_small_sets_keep_their_links():
    level = np.zeros(1 << jaccard.SLOT_BITS, np.uint8)
    rng = np.random.default_rng(1)
    for n in range(1, 60):
        a = np.sort(rng.integers(1, 1 << 63, n).astype(np.uint64))
        for m in range(n, min(n + 12, len(a) + 12)):
            b = np.sort(np.concatenate([a, rng.integers(1, 1 << 63, m - n).astype(np.uint64)]))
            if n != m and 100 * n >= 85 * m:
                for frequent in (0, 255):
                    shared = np.intersect1d(jaccard.index_keys(a, level, frequent, 85, 40), jaccard.index_keys(b, level, frequent, 85, 40))
                    assert len(shared), (n, m, frequent)


def test_sketch_is_a_bound():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64) * np.uint64(0x9E3779B9))
        b = np.unique(np.concatenate([a[20:], rng.integers(0, 1 << 40, 30).astype(np.uint64)]))
        bits = int(np.bitwise_count((jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


# repeat removal


def brute_repeats(rows, length):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - length + 1):
            key = float("inf") if i is None else i
            first[t[k : k + length]] = min(first.get(t[k : k + length], key), key)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < (float("inf") if i is None else i):
                gone[k : k + length] = [True] * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "chunk"), [(50, 2 << 20), (20, 300), (33, 1)])
def test_repeats(spark, length, chunk):
    rows = [(i, t) for i, t, _ in corpus(5, 40)] + [(3, "é" * 60), (9, "x" + "é" * 70), (4, None), (6, ""), (None, "é" * 60), (1000, "ab" * 60), (1000, "ab" * 60)]
    df = make(spark, [(i, t, None) for i, t in rows], 4)
    got = suffix.remove_repeats(spark, df, length, chunk).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows, length)


def test_repeats_odd(spark):
    got = {r["doc_id"]: r["n_removed"] for r in suffix.remove_repeats(spark, odd(spark)).collect()}
    assert got[4] == 0 and got[5] == len(LONG) and got[1] == 0
    assert suffix.remove_repeats(spark, empty(spark)).collect() == []


# tokens


def test_token_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.load_pieces(tokens.VOCABULARY)
    reference = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(1)
    texts = ["", " ", "a  b", "▁a▁", "<s> <0x41>", "漢字𠀀", "x" * 3000] + ["".join(rng.choice("ab \n▁é漢<s>0x") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    counter = tokens.Counter(pieces)
    assert [counter.text(x)[0] for x in texts] == [len(reference.encode(x, add_special_tokens=False).ids) for x in texts]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark, odd(spark)).collect()}
    assert got[1] == got[2] == 0 and got[4] == len(reference.encode(LONG, add_special_tokens=False).ids)
    assert tokens.count_tokens(spark, empty(spark)).collect() == []


def test_unknown_runs_without_byte_pieces():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("aba", -6.0)]
    reference = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    counter = tokens.Counter(pieces)
    for word in ("▁ab", "▁aba", "▁xxab", "▁axxb", "▁xaxbx", "▁abab"):
        assert counter.word(word)[0] == len(reference.encode(word).ids), word


# HTML


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>menu one</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>Title &amp; more</h1><p><b>First  paragraph
is here, and it is long enough.<br><p>Tiny.</p><div class="comments"><p>I disagree, and this comment is quite long indeed.</p></div><p>Last &eacute;.</p></article><aside>aside text</aside><footer>&copy; foot</footer>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Title & more\nFirst paragraph is here, and it is long enough.\nTiny.\nLast é."
    assert html.main_text("<div>menu</div>" + "<p>" + "A long and plain paragraph without any article around it. " * 3 + "</p><p>" + "More of it follows here. " * 5 + "</p>").startswith("A long")
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<nav>only</nav>"), (1, "u", PAGE), (5, "z", "<p>" * 5000 + "x")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_main_text(df).collect()}
    assert got[2] == got[3] == got[4] == ("", 0) and got[5] == ("x", 1)
    assert html.extract_main_text(df.limit(0)).collect() == []


LONG_LINE = "A long and plain paragraph that stands without any article around it. " * 4


def test_html_short_edges_without_article():
    long = LONG_LINE.strip()
    body = f"<h1>Short</h1><p>{long}</p><p>Mid.</p><p>{long}</p><p>{long}</p><p>The end.</p>"
    want = "\n".join(["Short", long, "Mid.", long, long, "The end."])
    assert html.main_text(f"<body><div>menu</div><div>{body}</div><div><a>one</a> <a>two</a></div></body>") == want
    assert html.main_text(f"<body><div>menu</div>{body}<div>tail</div></body>") == want
    assert html.main_text(f"<body><div><section>{body}</section><section><h2>Two</h2><p>{long}</p><p>Last.</p></section></div><div>tail</div></body>") == f"{want}\nTwo\n{long}\nLast."


def test_html_names():
    long = LONG_LINE.strip()
    assert html.main_text(f'<article><div class="ad-free share-price"><p>{long}</p></div><div class="x ad"><p>{long}</p></div></article>') == long
    assert html.main_text(f'<div class="menu page"><p>gone</p><article class="related"><h1>Short</h1><p>{long}</p><div class="comments"><article><p>{long}</p></article></div></article><p>gone</p></div>') == f"Short\n{long}"
    assert html.main_text(f"<nav><div class=menu><article><p>{long}</p></article></div></nav>") == ""


def test_html_clusters_decide():
    long = LONG_LINE.strip()
    menu = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(6))
    assert html.main_text(f"<article><h1>Top</h1><p>{long}</p><ul>{menu}</ul><p>{long}</p></article>") == f"Top\n{long}\n{long}"
    assert html.main_text(f"<article><p>teaser</p></article><div><h1>Top</h1><p>{long}</p><p>{long}</p></div>") == f"Top\n{long}\n{long}"
    assert html.main_text(f'<article class="social-science"><p>{long}</p><p><a href=x>one link</a></p><p>{long}</p></article>') == f"{long}\none link\n{long}"


def test_html_ratios_against_plain_loops():
    rng = random.Random(9)
    for _ in range(30):
        ratios = [rng.choice([0.0, rng.random() * 100]) for _ in range(rng.randint(1, 40))]
        got = html.smoothed(np.array(ratios), 1.0, 2)
        weights = [np.exp(-(k * k) / 2) for k in range(-2, 3)]
        for i in range(len(ratios)):
            near = [(w, ratios[i + k]) for k, w in zip(range(-2, 3), weights) if 0 <= i + k < len(ratios)]
            assert got[i] == pytest.approx(sum(w * x for w, x in near) / sum(weights))


def test_html_on_made_pages(spark):
    """Pages of a known article, in several layouts; nearly all must come out to the letter."""
    rng = random.Random(12)
    pages, want = [], {}
    for k in range(150):
        body = [words(rng, rng.randint(2, 6))] + [words(rng, rng.randint(15, 90)) + "." for _ in range(rng.randint(3, 12))] + ["The end."]
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{p}</p>" for p in body[1:])
        links = "".join(f"<li><a href=/{j}>{words(rng, 1)}</a></li>" for j in range(rng.randint(3, 9)))
        article = [f"<article>{inner}</article>", f"<main><div>{inner}</div></main>", f"<div><div>{inner}</div></div>"][k % 3]
        outer = [f"<nav><ul>{links}</ul></nav>{article}<footer>about us</footer>", f"<div><ul>{links}</ul></div>{article}<div><a href=/>home</a></div>", f'{article}<div class="comments"><p>{words(rng, 30)}</p></div>'][k // 3 % 3]
        pages.append((k, f"u{k}", f"<html><head><title>t</title><script>var x;</script></head><body>{outer}</body></html>", "clash"))
        want[k] = "\n".join(body)
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    deep = html.main_text("<div>" * 20_000 + "<p>" + LONG_LINE + "</p>" + "</span></b>" * 20_000)
    assert deep == LONG_LINE.strip() and len(html.main_text("<p>" + "word " * 400_000 + "</p>")) == 1_999_999


# classifiers


def test_language_against_plain_sets(spark):
    """The filter's decisions are those of exact sets, but for a false positive of the Bloom filter here and there."""
    rng = random.Random(14)
    kinds = {"aa": [a + b for a in "bdg" for b in ("an", "or", "i")], "bb": [a + b for a in "kpt" for b in ("ul", "esch", "ö")], "cc": [a + b for a in "bkz" for b in ("an", "ul", "ya")]}
    rows = [(i, words(rng, 25, kinds[k]), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    model = langid.fit_languages(spark, make(spark, rows[:90]))
    counts = {k: {} for k in kinds}
    for _, t, k in rows[:90]:
        for h in langid.grams(t).tolist():
            counts[k][h] = counts[k].get(h, 0) + 1
    kept = {k: {h: n for h, n in c.items() if n >= 2} for k, c in counts.items()}
    rate = {k: {h: n / sum(c.values()) for h, n in c.items()} for k, c in kept.items()}
    top = {}
    for c in rate.values():
        for h, x in c.items():
            top[h] = max(top.get(h, 0), x)
    sets = {k: {h for h, x in c.items() if x * 3 >= top[h]} for k, c in rate.items()}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect_languages(spark, make(spark, rows), model).collect()}
    want = {i: max(sorted(sets), key=lambda k: sum(h in sets[k] for h in langid.grams(t).tolist())) for i, t, _ in rows}
    assert sum(got[i] == want[i] for i in want) >= len(want) - 1


def test_quality_against_dense_training(spark):
    rng = random.Random(15)
    rows = [(i, words(rng, 30) if i % 2 else " ".join(w.upper() for w in words(rng, 30).split()), None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    weights, bias = quality.fit_quality(spark, make(spark, rows), labels)
    hasher = quality.Hasher()
    order = [r["id"] for r in spark.range(60).select("id", F.xxhash64("id", F.lit(1)).alias("h")).orderBy("h", "id").collect()]
    z, n, zb, nb = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS), 0.0, 0.0
    dense = lambda: np.where(np.abs(z) <= 0.02, 0.0, -(z - np.sign(z) * 0.02) / ((1 + np.sqrt(n)) / 0.3 + 0.1))
    for _ in range(10):
        for i in order:
            x = np.zeros(1 << quality.BITS)
            index, value = hasher.features(rows[i][1])
            x[index] = value
            w, b = dense(), -zb / ((1 + nb**0.5) / 0.3)
            g = 1 / (1 + np.exp(-(w @ x + b))) - i % 2
            step = np.sqrt(n + (g * x) ** 2) - np.sqrt(n)
            z, n = z + g * x - step / 0.3 * w, n + (g * x) ** 2
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / 0.3 * b, nb + g * g
    assert weights == pytest.approx(dense().astype(np.float32), abs=1e-4) and bias == pytest.approx(-zb / ((1 + nb**0.5) / 0.3), abs=1e-4)


def test_language(spark):
    rng = random.Random(4)
    kinds = {"aa": [a + b for a in "bdg" for b in ("an", "or", "i")], "bb": [a + b for a in "kpt" for b in ("ul", "esch", "ö")]}
    rows = [(i, words(rng, 30, kinds[k]), k) for i, k in enumerate(["aa", "bb"] * 60)]
    model = langid.fit_languages(spark, make(spark, rows[:60]))
    got = {r["doc_id"]: r for r in langid.detect_languages(spark, make(spark, rows), model).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows)
    strange = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.detect_languages(spark, odd(spark), model).collect()}
    assert strange[1] == strange[2] == strange[3] == strange[8] == ("und", 0.0) and strange[6][0] in kinds
    none = langid.fit_languages(spark, empty(spark))
    assert {r["lang_pred"] for r in langid.detect_languages(spark, odd(spark), none).collect()} == {"und"}
    assert langid.detect_languages(spark, empty(spark), model).collect() == []


def test_language_filter_has_no_false_negatives():
    model = langid.Filter(["a", "b", "c"], bits=12)
    sets = [np.random.default_rng(k).integers(0, 1 << 63, 500).astype(np.uint64) for k in range(3)]
    for k, s in enumerate(sets):
        model.add(k, s)
    for k, s in enumerate(sets):
        assert ((model.masks(s)[:, 0] >> np.uint64(k)) & np.uint64(1)).all()
    assert len(langid.grams("é")) > 0 and len(langid.grams("1 2 !")) == 0


def test_quality(spark):
    rng = random.Random(6)
    good = [(i, words(rng, 40), None) for i in range(0, 120, 2)]
    bad = [(i, " | ".join(words(rng, 40).split()), None) for i in range(1, 120, 2)]
    docs = make(spark, good + bad)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)] + [(3, None), (None, 1), (0, 1)], "doc_id long, quality int")
    model = quality.fit_quality(spark, docs, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(spark, docs, model).collect()}
    assert all(got[i]["predicted"] == 1 - i % 2 for i in range(80, 120))
    kept = quality.keep_quality(spark, docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(spark, odd(spark), model).collect())
    none = quality.fit_quality(spark, empty(spark), labels.limit(0))
    assert {r["score"] for r in quality.score_quality(spark, odd(spark), none).collect()} == {0.5}
    assert quality.score_quality(spark, empty(spark), model).collect() == []


# mixing


def test_mixing(spark):
    rng = random.Random(8)
    kinds = {"x": ["red", "green", "blue"], "y": ["one", "two", "three"], "z": ["cat", "dog", "cow"]}
    names = ["x"] * 60 + ["y"] * 30 + ["z"] * 10
    rows = [(i, words(rng, 20, kinds[k]), k) for i, k in enumerate(names)]
    docs = make(spark, rows)
    labelled = spark.createDataFrame([(i, k) for i, _, k in rows if i % 2 == 0] + [(None, "x"), (1, None), (2, "other")], "doc_id long, domain string")
    targets = {"x": 0.2, "y": 0.3, "z": 0.5}
    out = mixing.soft_mix(docs, labelled, targets)
    got = out.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{k}")).alias(k) for k in targets], F.sum("n_tokens").alias("n"), F.min("rate").alias("least")).first()
    for k, w in targets.items():
        assert got[k] / got["n"] == pytest.approx(w, abs=2e-3)
    assert got["least"] >= 0
    everything = mixing.soft_mix(docs, labelled, targets, keep_columns=True)
    assert set(docs.columns) <= set(everything.columns) and everything.count() == len(rows)
    one = mixing.soft_mix(docs, labelled, {"x": 1.0, "y": 0.0, "z": 0.0}, budget=500.0).where("rate < 0").count()
    assert one == 0
    strange = {r["doc_id"]: r for r in mixing.soft_mix(odd(spark), labelled.limit(0), targets).collect()}
    assert strange[1]["n_tokens"] == 0 and strange[1]["p_x"] == pytest.approx(1 / 3)
    assert mixing.soft_mix(empty(spark), labelled, targets).collect() == []


def test_mixing_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3] * 3, 80)
    tokens = rng.integers(0, 50, 80)
    members = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(tokens, p)], "n_tokens long, p_a double, p_b double, p_c double")
    model = mixing.Domains(["a", "b", "c"], [0.0] * 3, [[0.0]] * 3)
    share = tokens / tokens.sum()
    for targets, budget in (({"a": 0.6, "b": 0.3, "c": 0.1}, None), ({"a": 0.5, "b": 0.3, "c": 0.2}, 300.0), ({"a": 0.2, "b": 0.2, "c": 0.6}, 5000.0)):
        want = np.array([targets[d] for d in "abc"]) * (budget or tokens.sum()) / tokens.sum()
        rate = np.ones(80)
        for _ in range(20_000):
            rate = np.maximum(0, rate - p @ ((share * rate) @ p - want))
        steps = mixing.fit_rates(members, model, targets, budget)
        got = np.array([r["rate"] for r in members.withColumn("rate", mixing.rate_of(model, steps)).collect()])
        assert (got >= 0).all()
        assert (share * got) @ p == pytest.approx((share * rate) @ p, abs=1e-5)


def test_mixing_reports_a_gap(spark):
    rng = random.Random(8)
    kinds = {"x": ["red", "green", "blue"], "y": ["one", "two", "three"]}
    rows = [(i, words(rng, 20, kinds[k]), k) for i, k in enumerate(["x"] * 30 + ["y"] * 10)]
    docs = make(spark, rows)
    labelled = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labelled, ["x", "y"])
    members = mixing.with_membership(docs, model)
    with pytest.warns(RuntimeWarning, match="gap of"):
        mixing.fit_rates(members, model, {"x": 0.1, "y": 0.9}, most=0)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        mixing.fit_rates(members, model, {"x": 0.1, "y": 0.9})
        mixing.fit_rates(members, model, {"x": 0.9, "y": 0.1}, budget=500.0)


def test_mixing_plans_do_not_grow_with_the_steps(spark):
    model = mixing.Domains(["x", "y"], [0.0, 0.0], [[0.0], [0.0]])
    members = spark.createDataFrame([(0.9, 0.1), (0.2, 0.8), (0.5, 0.5)], "p_x double, p_y double")
    steps = [[0.1 * ((k % 5) - 2), 0.03 * (k % 3)] for k in range(60)]
    nodes = {}
    for n in (0, 1, 2, 60):
        rated = members.withColumn("rate", mixing.rate_of(model, steps[:n]))
        nodes[n] = rated._jdf.queryExecution().optimizedPlan().toString().count("greatest")
        for row in rated.collect():
            want = 1.0
            for x, y in steps[:n]:
                want = max(0.0, want - (row["p_x"] * x + row["p_y"] * y))
            assert abs(row["rate"] - want) < 1e-12
    assert nodes[60] == nodes[2] <= 2
