"""Edge cases and brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from metricloom.llm import common, decontaminate, languages, mixing, near_duplicates, quality, sharding, substrings, token_counts, token_files, url_filters
from metricloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, key string, bucket int, starts int, topic string"


def texts():
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}x" for _ in range(500)] + ["the", "of", "Berlin,", "12", "km"] * 20
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = some(40)
    base = some(120).split()
    near = [" ".join([*base[:60], f"n{i}", *base[61:]]) for i in range(6)]
    out = [None, "", "  \t\n", "one", "the the the " * 30, some(4), passage, some(30) + " " + passage, passage + "\n" + some(20), *near, " ".join(base), " ".join(base), "a\x00b c d é" * 9, "x" * 5000, some(9000)]
    return out + [some(rng.randrange(20, 90)) + f"\nline {i % 3}\nline {i % 3}" for i in range(40)]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None if i % 7 == 3 else "en" if i % 2 else "de", None if i % 5 == 4 else f"s{i % 3}", 0, 0, False, "k", 1, 2, "t") for i, t in enumerate(rows)], SCHEMA)


def with_odd_rows(df):
    """A null id, and one row twice."""
    return df.unionByName(df.filter("doc_id = 6")).unionByName(df.filter("doc_id = 7").selectExpr("cast(null as long) as doc_id", *df.columns[1:]))


def split(text):
    return text.encode().split() if text else []


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark).limit(0)


def bench(spark):
    return spark.createDataFrame([(1, texts()[6]), (2, None), (3, "too short"), (4, "If a train leaves Madrid at 7 and travels 300 km in 7 hours what is the average speed of it")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(20, 55)] + [(20, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_substrings(spark, docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(substrings.drop_repeats(docs)).collect()}
    first = {}
    for i, t in enumerate(texts()):
        w = split(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    removed = 0
    for i, t in enumerate(texts()):
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        removed += len(w) - len(kept)
        assert got[i] == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    assert removed > 400
    assert substrings.drop_repeats(empty).count() == 0 and substrings.drop_repeats(with_odd_rows(docs)).count() == len(got) + 2


def test_near_duplicates(spark, docs, empty):
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(docs).collect()}
    sets = []
    for t in texts():
        w = t.encode().lower().split() if t else []
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)} and sum(r != i for i, r in enumerate(root)) >= 6
    assert near_duplicates.near_duplicates(empty).count() == 0 and near_duplicates.near_duplicates(with_odd_rows(docs)).count() == len(got) + 2


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.r_[a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    s = near_duplicates.sketches([a, b, a[:1], np.empty(0, np.uint64)])
    assert (s[:3] != np.uint64(2**64 - 1)).all() and abs((s[0] == s[1]).mean() - 900 / 1100) < 0.15


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    lib, path = Tokenizer.from_file(vocabulary()), vocabulary()
    want = {i: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(texts())}
    start = 0
    got = {r.doc_id: r for r in token_files.token_files(docs, path).collect()}
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, path, 100).collect()}
    for i, ids in want.items():
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((texts()[i] or "").encode()), len(ids) - 1, len(ids) - 1 > 100)
        start += len(ids)
    r = token_files.reader(got[5].file)
    assert np.frombuffer(r.document(got[5].place), "<u4").tolist() == want[5].tolist()
    assert token_files.token_files(empty, path).count() == 0 and token_counts.token_counts(empty, path).count() == 0
    assert token_files.token_files(with_odd_rows(docs), path).count() == len(got) + 2


def test_transducer_in_chunks(monkeypatch):
    from tokenizers import Tokenizer

    rng, lib = random.Random(8), Tokenizer.from_file(vocabulary())
    pieces = ["a", "the", "ing", "Hello", "é", "e\u0301", "ß", "日本", "。", "，", "7", "12", "!", "..", "'s", "'", "|", "<|", "<|endoftext|>", "-", "_", " ", "\n", "\u00a0", "\x1c", "Σ", "İ", "ſ"]
    some = [*texts(), *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(300)), "x" * 700 + "é" * 30 + "y1" * 300]
    for chunk, long, arcs in ((5, 6, 600_000), (16, 9, 40), (1 << 16, 1 << 12, 600_000)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "ARCS", arcs)
        monkeypatch.setattr(token_counts.cut_word, "__defaults__", (long,))
        counter, coder = token_counts.Transducer(vocabulary()), token_files.Encoder(vocabulary())
        for text in some:
            data = (text or "").encode()
            want = lib.encode(text or "", add_special_tokens=False).ids
            assert counter.text(data) == len(want), (chunk, text)
            assert np.frombuffer(coder.ids([data])[0], "<u4").tolist() == want, (long, text)


def test_maps_compose_associatively(monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    counter = token_counts.Transducer(vocabulary())
    text = "one unbrokenlongword2with3digits and some'more — words\n at theend" * 3
    maps = [((), 0, token_counts.Open()), *(counter.state_map(text.encode()[i : i + 7]) for i in range(0, len(text.encode()), 7))]
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = counter.then(left, m)
    for m in maps[-2::-1]:
        right = counter.then(m, right)
    assert left[1] + counter.close(left[2]) == right[1] + counter.close(right[2]) == counter.text(text.encode())


def test_frames_detect_damage(tmp_path):
    with open(tmp_path / "f", "wb") as f:
        w = token_files.Writer(f)
        for i in range(5):
            w.add(i, np.arange(100_000, dtype="<u4").tobytes())
        w.close()
    data = bytearray((tmp_path / "f").read_bytes())
    ok = token_files.Reader(lambda o, n: bytes(data[o : o + n]), len(data))
    assert np.frombuffer(ok.document(3), "<u4").sum() == sum(range(100_000))
    at = int(ok.at[ok.starts.searchsorted(ok.bounds[3], "right") - 1]) + 20
    data[at] ^= 1  # a byte of a frame that the document lies in
    ok.last = (-1, b"")
    with pytest.raises((ValueError, zstandard.ZstdError)):
        ok.document(3)
    assert np.frombuffer(ok.document(0), "<u4").sum() == sum(range(100_000))  # others can still be read


def test_sharding(spark, docs, empty):
    rows = sharding.shard(with_odd_rows(docs)).collect()
    assert len(rows) == len(texts()) + 2
    n = collections.Counter(r.shard for r in rows)
    assert len(n) == 24 and max(n.values()) - min(n.values()) <= 1
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        t = (texts()[r.doc_id] or "").encode() if r.doc_id is not None else texts()[7].encode()
        assert r["size"] == len(t) + 8 and r.text_crc32 == zlib.crc32(t)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    at = {r.doc_id: r.shard for r in rows}
    assert at[15] == at[16]  # equal texts
    assert sharding.shard(empty).count() == 0


def test_sharding_hot_group(spark):
    df = spark.range(600).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same' else cast(id as string) end as text")
    rows = sharding.shard(df).collect()
    hot = collections.Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert set(collections.Counter(r.shard for r in rows).values()) == {25} and len(hot) <= 12


def test_quality(spark, docs, empty):
    rows = quality.judged(docs, labels(spark)).collect()
    assert len(rows) == len(texts())
    for r in rows:
        w = split(texts()[r.doc_id])
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (len(w), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert r.kept == (not r.base_failed)  # too few labels to prove a cutoff
    assert quality.judged(empty, labels(spark)).count() == 0 and quality.judged(docs, labels(spark).limit(0)).count() == len(rows)


def test_binomial_bound():
    assert quality.at_most(0, 300, 0.01, 0.05) and not quality.at_most(0, 290, 0.01, 0.05)  # 1 - 0.05 ** (1 / n)
    assert quality.at_most(3, 800, 0.01, 0.05) and not quality.at_most(9, 800, 0.01, 0.05)


def test_quality_rejects_proved_metrics(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    rows = [(i, clean() if i % 8 else clean().replace(" ", " ## "), "en") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judged(df, marks).filter("kept").collect()}
    assert not any(i in kept for i in range(0, 4000, 8)) and sum(i in kept for i in range(4000) if i % 8) >= 3400


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/1", "https://www.example.com/en/x?q#f", "http://a.b.net/fr/", "http://xnet/es/", "http://spam-farm.org", "ftp://x.com", "http://x.com?/a", "http://x.org/a/login"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/1", "example.com/en/", "block") and got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5] == ("a.b.net", "/fr/", "net/fr/", "block") and got[6] == ("xnet", "/es/", None, "allow")
    assert got[7][3] == "block" and got[8] == ("x.com", "", None, "allow") and got[9] == ("x.com", "", None, "allow") and got[10][3] == "block"
    assert url_filters.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, ()).collect()} == {"allow"}
    # thousands of rules, one without tokens, one of other scripts, equal weights
    many = tuple(url_filters.pattern_rule(f"r{i}", "block", rf"\A(?:[^ ]*\.)?bad{i}\.org ", f"bad{i}", "org") for i in range(3000))
    odd = (url_filters.pattern_rule("any-f", "block", "f"), url_filters.pattern_rule("a-tie", "allow", " /en/", "en"), url_filters.pattern_rule("script", "block", "ü"))
    more = spark.createDataFrame([(0, "http://x.bad77.org/"), (1, "http://bad3000.org/"), (2, "http://ok.org/f"), (3, "http://ok.org/en/f"), (4, "http://ok.org/ü"), (5, None), (6, "http://BAD5.org/"), (None, "http://bad5.org/x")], "page_id long, url string")
    verdicts = {(r.page_id, r.url): r.verdict for r in url_filters.judge(more, many + odd).collect()}
    assert [verdicts[k] for k in sorted(verdicts, key=str)] == ["block", "allow", "block", "allow", "block", "allow", "block", "block"]


def test_decontamination(spark, docs, empty):
    rows = {r.doc_id: r.item_id for r in decontaminate.decontaminate(docs, bench(spark)).collect()}
    assert len(rows) == len(texts()) and {i for i, x in rows.items() if x} == {6, 7, 8}
    more = ["Say: if a train leaves Lisbon at 9 and travels 450 km in 9 hours what is the average speed of it then", "if a train leaves the yard then nobody travels far at all in any of the three hours that it takes", "if a train leaves Rome at 7 and travels 300 km in 4 hours what is the average speed of it"]
    found = {r.doc_id: r.item_id for r in decontaminate.decontaminate(frame(spark, more), bench(spark)).collect()}
    assert found == {0: 4, 1: None, 2: None}  # the last fills the item's 7 in two ways
    assert decontaminate.decontaminate(empty, bench(spark)).count() == 0 and decontaminate.decontaminate(docs, bench(spark).limit(0)).filter("contaminated").isEmpty()


def test_languages(spark, empty):
    rng = random.Random(2)
    say = lambda words: " ".join(rng.choice(words) for _ in range(40))
    en, de = ["the", "house", "with", "which", "thing", "other"], ["der", "haus", "nicht", "welche", "straße", "über"]
    rows = [(i, say(en if i % 2 else de), "en" if i % 2 else "de", f"h{i % 2}", "x") for i in range(60)] + [(60, say(de), "en", None, "x"), (61, "", "en", "h1", "x"), (62, None, None, None, "x"), (63, "123 456", "en", "h1", "x"), (64, say(en), None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, posterior string")
    got = {r.doc_id: (r.language, r.kept) for r in languages.identify(df).collect()}
    assert all(got[i] == ("en" if i % 2 else "de", True) for i in range(60)) and got[60] == ("de", True) and got[64] == ("en", True)
    assert got[61] == got[62] == got[63] == ("und", False)
    assert languages.identify(empty).count() == 0
    pages = spark.createDataFrame([(i, f"http://a{i % 2}.{'com' if i % 2 else 'de'}/", f'<html lang="{"en" if i % 2 else "de"}"><script>var x</script><p>{rows[i][1]}</p></html>') for i in range(40)] + [(40, None, None)], "page_id long, url string, html string")
    judged = {r.page_id: r.language for r in languages.identify_pages(pages).collect()}
    assert all(judged[i] == ("en" if i % 2 else "de") for i in range(40)) and judged[40] == "und"


def test_mixing(spark, docs, empty):
    cells = spark.createDataFrame([("a", "en", "p", 900), ("a", "de", "p", 100), ("b", "en", "p", 50), ("b", "de", "q", 450)], "source string, lang string, topic string, tokens long")
    goal = spark.createDataFrame([("source", "a", 0.4), ("source", "b", 0.6), ("lang", "en", 0.5), ("lang", "de", 0.5), ("topic", "p", 0.7), ("topic", "q", 0.3)], "margin string, value string, target double")
    got = mixing.raked(cells, goal, 30, 1e-4).collect()
    for margin, value, target in goal.collect():
        assert abs(sum(r.weight * r.tokens for r in got if r[margin] == value) - target) < 0.02
    rows = mixing.mix(with_odd_rows(docs)).collect()
    assert len(rows) == len(texts()) + 2 and all(0 < r.probability <= 1 for r in rows)
    again = {r.doc_id: r.sampled for r in mixing.mix(docs).collect()}
    assert again == {r.doc_id: r.sampled for r in mixing.mix(docs).collect()} and mixing.mix(empty).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {6, 7, 8}.isdisjoint(r.doc_id for r in out) and {0, 1, 2, 16}.isdisjoint(r.doc_id for r in out)
    total = 0
    for r in sorted(out, key=lambda r: r.doc_id):
        assert r.start == total
        total += r.n_tokens


def test_near_dedup_takes_pairs_at_080(spark, tmp_path):
    import corpus_pipeline

    words = [f"v{i}" for i in range(104)]  # 100 shingles
    near = [*words[:50], "other", *words[51:]]  # 95 of 105: 0.905
    mid = [*words[:30], "other", *words[31:70], "more", *words[71:]]  # 90 of 110: 0.818
    docs = frame(spark, [" ".join(w) for w in (words, near)])
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
    docs = frame(spark, [" ".join(w) for w in (words, mid)])
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
    assert all(r.kept for r in near_duplicates.near_duplicates(docs).collect())


def test_mixing_outlier_leaves_the_scale(spark, caplog):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(i, text(100), "en" if i % 3 else "de", f"s{i % 4}") for i in range(400)] + [(400, text(20), "es", "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs).collect()
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.probability * r.n_tokens for r in got) - mixing.KEPT * total) < 0.01 * total
    assert [r.probability for r in got if r.source == "alone"] == [1.0] and "('source', 'alone'" in caplog.text


def test_quality_rejects_with_few_labels(spark):
    clean = lambda i: " ".join(f"w{(i * 37 + k * k) % 3001}" for k in range(60))
    rows = [(i, clean(i) if i % 8 else clean(i).replace(" ", " ## "), "de") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")  # 350 good ones
    kept = {r.doc_id for r in quality.judged(df, marks).filter("kept").collect()}
    assert not any(i % 8 == 0 for i in kept) and len(kept) >= 343


def test_rare_language_is_modelled(spark, monkeypatch):
    monkeypatch.setattr(languages, "TRAIN", 40)
    rows = [(i, f"the quick brown fox number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10 % 10]} {'uvwxyzabcd'[i // 100]} jumps", "en") for i in range(990)]
    rows += [(1000 + i, f"der schnelle braune fuchs {'abcdefghij'[i]} springt", "de") for i in range(6)] + [(2000 + i, "el zorro salta", "es") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert languages.fit(docs, "text", "lang")[0] == ["de", "en", "es"]


def test_stages_keep_rows_of_null_and_shared_ids(spark, tmp_path):
    import corpus_pipeline

    text = lambda seed: " ".join(f"{'abcdefghijklmnop'[(seed * 7 + k * k * seed + k) % 16]}{'klmnopqrstuvwxyz'[k % 16]}on{'abcdef'[seed % 6]}" for k in range(60))
    rows = [(1, text(1)), (2, text(1)), (3, text(3)), (3, text(4)), (3, text(4)), (3, text(1)), (None, text(5)), (None, text(6)), (None, text(6)), (None, text(3)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert got == sorted([(1, text(1)), (3, text(3)), (3, text(4)), (0, text(5)), (0, text(6)), (0, "")])
    named = corpus_pipeline.language_id(spark, docs, "").collect()
    assert len(named) == len(rows) - 1 and all(r.text for r in named)
    spark.createDataFrame([(1, text(6))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert len(clean) == len(rows) - 2 and all(r.text != text(6) for r in clean)


def test_decontamination_finds_literal_copies(spark):
    sums = "12 7 plus 44 9 minus 81 6 times 5 3 and 2 8 or 4 1"  # every window holds five numbers or six
    items = spark.createDataFrame([(1, sums), (2, "name the largest moon of Jupiter"), (3, "too short")], "item_id long, text string")
    texts = [f"some words before {sums} and after", f"some words {sums.replace('12', '13').replace('81', '82').replace('44', '45')} after", "please name the largest moon of Jupiter now", "name the largest moon of Saturn", "far too short a text to be found"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_matched) for r in decontaminate.decontaminate(docs, items).filter("contaminated").collect()}
    # the second has the item's words with other numbers
    assert got == {0: (1, 17), 1: (1, 17), 2: (2, 6)}


def test_symbols_are_consistent_inside_equal_substrings():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 60, 4000).astype(np.uint64)
    one, two = substrings.symbol_ends(words)
    assert 0.6 < one.mean() < 0.85 and two.mean() < one.mean() and not (two & ~one).any()
    names = substrings.anchors(words)[1]
    for a in rng.integers(0, len(words) - 13, 200).tolist():
        window = words[a : a + 13]
        elsewhere = np.r_[rng.integers(0, 60, 20).astype(np.uint64), window, window[:5]]
        assert substrings.anchors(window)[1][0] == names[a] == substrings.anchors(elsewhere)[1][20]
        ends = substrings.symbol_ends(elsewhere)[1]
        assert (ends[22:32] == two[a + 2 : a + 12]).all()


def test_substrings_with_shared_ids_ranges_and_runs(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    run = "the " * 40
    rows = [(1, passage + " x y"), (1, "other words before " + passage), (2, "z " + passage + " z"), (2, " ".join(f"q{i}" for i in range(30))), (3, run + "a"), (4, "b " + run), (5, None), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7, 64):
        got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.drop_repeats(docs, parts).collect()))
        assert got == sorted([(1, 22, 0), (1, 23, 0), (2, 22, 20), (2, 30, 0), (3, 41, 0), (4, 41, 40), (5, 0, 0), (0, 20, 0)])


def template(text, openers=True):
    """The words and their kinds, read anew with the standard library."""
    units = set(decontaminate.UNITS.split("|"))
    out, before, ends = [], None, True
    for raw in text.split():
        bare = raw.lstrip("\"'(\u201c\u2018")
        w = re.sub(r"[!-/:-@\[-`{-~]", "", raw.lower())
        kind = "w"
        if any(c.isdigit() for c in w):
            kind = "n"
        elif bare[:1].isupper() and bare[1:2].isalpha() and (openers or not ends):
            kind = "p"
        elif w in units and before is not None and re.fullmatch(r"[^a-z]*[0-9]+", before):
            kind = "u"
        ends = raw[-1] in ".!?"
        before = raw.lower()
        if w:
            out.append((kind, w))
    return out


def contaminated(text, items):
    """The items that every pair of windows, compared one by one, finds."""
    doc, found = template(text), set()
    for item, question in items:
        for openers in (True, False):
            q = template(question, openers)
            same = lambda a, b: a[0] == b[0] and (a[0] != "w" or a[1] == b[1])
            windows = [i for i in range(len(q) - 7) if sum(k == "w" for k, _ in q[i : i + 8]) >= decontaminate.LITERALS]
            literals = lambda i: sum(k == "w" for k, _ in q[i : i + 8])
            for shift in range(-len(q), len(doc)):
                hit = [i for i in windows if 0 <= i + shift <= len(doc) - 8 and all(same(a, b) for a, b in zip(q[i : i + 8], doc[i + shift : i + shift + 8], strict=True))]
                if hit and len(hit) >= min(decontaminate.LEAST, len(windows)) and sum(map(literals, hit)) >= min(decontaminate.EVIDENCE, sum(map(literals, windows))):
                    span = range(hit[0], hit[-1] + 8)
                    slots = {(q[i], doc[i + shift]) for i in span if 0 <= i + shift < len(doc) and q[i][0] != "w" and q[i][0] == doc[i + shift][0]}
                    if len(slots) == len({a for a, _ in slots}):
                        found.add(item)
    return found


def test_decontamination_finds_reparameterised_questions(spark):
    rng = random.Random(11)
    nouns, verbs = ["apples", "pears", "crates", "tickets", "marbles"], ["buys", "sells", "packs", "counts"]
    items, docs, kinds = [], [], []
    noise = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "velit", "quis"]) for _ in range(30))
    for i in range(24):
        noun, verb, end = rng.choice(nouns), rng.choice(verbs), f"the {['red', 'old', 'tall', 'new'][i % 4]} {['barn', 'shop', 'yard', 'mill', 'dock', 'fair'][i // 4]}"
        make = lambda name, place, a, b, unit, noun=noun, verb=verb, end=end: f"{name} {verb} {a} {noun} of 3 kinds near {end} in {place} and carries each for {b} {unit} before lunch. How far do the {noun} travel with {name} that day?"
        items.append((i, make("Peter", "Madrid", 12, 40, "km")))
        for kind, text in {"copy": items[-1][1], "numbers": make("Peter", "Madrid", 31, 77, "km"), "names": make("Noura", "Lagos", 12, 40, "km"), "units": make("Peter", "Madrid", 12, 40, "miles"), "all": make("Ivo", "Oslo", 5, 9, "feet"), "lines": make("Peter", "Madrid", 12, 40, "km").replace(" and ", "\nand\t").replace(" in ", " in\n")}.items():
            docs.append(f"{noise()}. {text} {noise()}")
            kinds.append((kind, i))
    docs += [noise() + " Peter counts apples near the old barn. " + noise() for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.decontaminate(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for kind in {k for k, _ in kinds}:
        asked = [(j, i) for j, (k, i) in enumerate(kinds) if k == kind]
        assert sum(got[j] == i for j, i in asked) >= 0.9 * len(asked), kind
    assert all(got[j] is None for j in range(len(kinds), len(docs)))
    for j, text in enumerate(docs):
        if j % 5 == 0:
            found = contaminated(text, items)
            assert (got[j] in found) if found else got[j] is None


def test_language_posteriors_are_those_of_plain_sums(spark):
    rng = random.Random(4)
    words = {"en": ["the", "house", "with", "which"], "de": ["der", "haus", "nicht", "welche"], "fr": ["la", "maison", "avec", "quel"]}
    rows = []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 4))), [lang, None, "en"][i % 5 % 3], f"h{i % 4}" if i % 7 else None, ["com", "de", None][i % 3]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, suffix string")
    got = {r.doc_id: r for r in languages.identify(docs, suffix=F.col("suffix")).collect()}
    names, model = languages.fit(docs, "text", "lang")
    n = len(names)
    scores = {}
    for i, text, *_ in rows:
        total = model[languages.trigrams(text.encode())].sum(0, dtype=np.float64)
        scores[i] = np.maximum(languages.TEMPER * (total - total.max()), -languages.BOUND)
    best = {i: int(s.argmax()) for i, s in scores.items()}
    tally = lambda ids: np.bincount([best[i] for i in ids], minlength=n).astype(float)
    counts = tally(best) + 1
    whole = counts / counts.sum()
    blend = lambda ids, base, weight: (tally(ids) + weight * base) / (len(ids) + weight)
    for i, _, lang, host, suffix in rows:
        prior = blend([r[0] for r in rows if (r[4] or "") == (suffix or "")], whole, languages.SUFFIX_WEIGHT)
        if host is not None:
            prior = blend([r[0] for r in rows if r[3] == host and (r[4] or "") == (suffix or "")], prior, languages.HOST_WEIGHT)
        logs = scores[i] + np.log(prior)
        if lang is not None:
            logs = logs + np.log((tally([r[0] for r in rows if r[2] == lang]) + 0.5) / (counts + 0.5))
        odds = np.exp(logs - logs.max())
        assert names[int(logs.argmax())] == got[i].language and abs(got[i].posterior - 1 / odds.sum()) < 2e-6


def test_hot_keys_beyond_the_broadcast_bound(spark, monkeypatch):
    """The same results where sides are too large to be broadcast whole."""
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(30)]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 30] + (" tail" if i % 2 else ""), ["en", "de"][i % 2], None if i % 4 == 0 else f"s{i % 9 // 5}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    runs = {
        "shard": lambda: sharding.shard(docs, 6),
        "near": lambda: near_duplicates.near_duplicates(docs),
        "mix": lambda: mixing.mix(docs),
        "languages": lambda: languages.identify(docs),
        "urls": lambda: url_filters.judge(docs.selectExpr("doc_id as page_id", "if(doc_id % 3 = 0, null, concat('http://casino.x/', doc_id % 5)) as url")),
    }
    plain = {k: sorted(map(str, f().collect())) for k, f in runs.items()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 300)
    for k, f in runs.items():
        assert sorted(map(str, f().collect())) == plain[k], k


def test_components_of_a_long_chain_and_a_hub(spark):
    n = 300
    pairs = [(i, i + 1) for i in range(n)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5001), (5001, 5002), (5000, 5002), (5001, 5000)]
    got = {r.id: r.component for r in common.pair_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 1000 for i in range(1000, 1201)} | {5000: 5000, 5001: 5000, 5002: 5000}


def test_sharding_cuts_few_edges(spark):
    rows = [(i, f"t{i % 60}" if i < 240 else f"u{i}") for i in range(480)]
    got = {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows[:240]:
        groups[t].append(got[i])
    cut = sum(a != b for g in groups.values() for k, a in enumerate(g) for b in g[:k])
    every = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    assert cut <= 0.05 * every  # dealt at random, 7 of 8 edges are cut
