import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import components, licenses, lines, media, mixing, neardup, prefix_bpe, quality, secrets, spans, textvec, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta river stone cloud maple tiger ocean violet copper silver amber forest meadow".split()


def _prose(r, n):
    out = []
    for k in range(n):
        w = r.choice(WORDS) + r.choice(WORDS)[:3]
        out.append(w + ("." if k % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows."""
    r = random.Random(3)
    same = _prose(r, 80)
    rows = [(1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, same, "en", None, 2), (None, None, None, None, None), (4, _prose(r, 6000), "en", "b", 3), (5, " \n\t\n ", "en", "b", 3), (6, "é" * 300 + " x", "fr", "b", 3), (7, same + " tail", "en", "b", 3), (8, "a\u001cb c d", "en", "b", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_quality_counts_by_brute_force(spark, odd):
    extra = spark.createDataFrame([(20, "a b c d e f a b c d e\nx y\nx y\n # $ x", "en", "a", 1), (21, "a a a a a a a\n\n\n", "en", "a", 1)], SCHEMA)
    for row in quality.text_counts(odd.union(extra), ["doc_id", "text"]).collect():
        text, w = row["text"] or "", words_of(row["text"])
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = collections.Counter(runs)
        covered = {i + k for i, x in enumerate(runs) if many[x] > 1 for k in range(5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_quality_rejects_what_is_far_off(spark, odd, none):
    r = random.Random(1)
    rows = [(k, _prose(r, r.randint(60, 200)), "en", "s", 1) for k in range(120)]
    rows += [(1000 + k, " ".join(w + "%%%" for w in _prose(r, 60).split()), "en", "s", 1) for k in range(5)]
    got = {x["doc_id"]: x for x in quality.verdicts(quality.text_counts(spark.createDataFrame(rows, SCHEMA), ["doc_id", "lang", "source"])).collect()}
    assert all(got[k]["kept"] for k in range(120)) and not any(got[1000 + k]["kept"] for k in range(5))
    assert quality.verdicts(quality.text_counts(odd, ["doc_id", "lang", "source"])).count() == odd.count()
    assert quality.keep_good(none).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 2


def test_chi_square():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_lines_by_brute_force(spark, odd, none):
    r = random.Random(5)
    common = ["Share this page", "  COOKIES?\t", "cookies?"]
    rows = [(k, "\n".join(r.choice([*common, f"own line {k}", "", f"group {k % 7}"]) for _ in range(r.randint(1, 9))), "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = collections.Counter(k for x in rows for k in {key(y) for y in x[1].split("\n")} if k)
    want = {x[0]: [y for y in x[1].split("\n") if n[key(y)] < 10 or not key(y)] for x in rows}
    for row in lines.drop_common(docs).collect():
        assert row["text"] == "\n".join(want[row["doc_id"]])
        assert row["_n_dropped"] == row["_n_lines"] - len(want[row["doc_id"]])
    assert lines.drop_common(none).count() == 0
    out = {(x["doc_id"], x["text"]) for x in lines.drop_common(odd).collect()}
    assert (2, "") in out and (5, " \n\t\n ") in out


def test_line_runs_are_merged_and_exact(spark, monkeypatch):
    """Blocks of a few records: keys that end a block go on in the next."""
    monkeypatch.setattr(lines, "RECORDS", 3)
    r = random.Random(1)
    store = lines.LineStore(spark, buckets=3, min_docs=6)
    batches = [{(r.randrange(-40, 40) << 20, r.randrange(3)): r.randint(1, 4) for _ in range(90)} for _ in range(5)]
    for b in batches:
        store.add(spark.createDataFrame([(*k, v) for k, v in b.items()], "_k1 long, _k2 long, _n long"))
    assert [len(x) for x in store.levels] == [1, 0, 1]
    want = collections.Counter()
    for b in batches:
        want.update(b)
    assert store.distinct_lines() == len(want)
    assert {(x["_k1"], x["_k2"]) for x in store.settled().collect()} == {k for k, v in want.items() if v >= 6}
    assert {(x["_k1"], x["_k2"]): x["_n"] for x in store.open_counts().collect()} == {k: v for k, v in want.items() if v < 6}


def test_merged_streams_by_brute_force():
    r = np.random.default_rng(7)
    for _ in range(60):
        streams, want = [], collections.Counter()
        for _ in range(r.integers(0, 5)):
            keys = sorted({(int(a), int(b)) for a, b in zip(r.integers(-5, 5, 20), r.integers(0, 3, 20), strict=True)})
            n = [int(x) for x in r.integers(1, 9, len(keys))]
            want.update(dict(zip(keys, n, strict=True)))
            whole = lines._records([k[0] for k in keys], [k[1] for k in keys], n, False, False)
            cuts = np.sort(r.integers(0, len(keys), 3))
            streams.append(iter([x for x in np.split(whole, cuts) if len(x)]))
        got = [(int(x["k1"]), int(x["k2"]), int(x["n"])) for block in lines.merged(streams) for x in block]
        assert got == [(*k, want[k]) for k in sorted(want)]


def test_media_round_trip(odd, none):
    out = media.with_features(media.with_metadata(media.store(odd, ["doc_id", "text"], shard_bytes=3000))).collect()
    assert len(out) == odd.count()
    for x in out:
        raw = (x["text"] or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert (x["width"], x["height"], x["bit_depth"]) == (64, len(pad) // 64, 8) and x["media_bytes"] == x["length"]
    assert len({(x["shard"]) for x in out}) > 1
    assert media.with_features(media.store(none, ["doc_id"])).count() == 0


def test_media_shards_are_archives(odd):
    import tarfile

    rows = media.store(odd, ["doc_id"]).collect()
    with tarfile.open(rows[0]["shard"].removeprefix("file://")) as t:
        names = t.getnames()
        assert len(names) == len(set(names)) and f"{rows[0]['digest']}.png" in names
        first = t.getmembers()[0]
        assert hashlib.sha256(t.extractfile(first).read()).hexdigest() == first.name[:-4]


def _set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _classes(rows):
    """Least ids of components of all pairs with J >= 0.8; equal sets belong together."""
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        both = len(a & b)
        if a == b or both / (len(a) + len(b) - both) >= 0.8:
            up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_near_duplicates_by_brute_force(spark, odd, none):
    r = random.Random(9)
    rows = []
    for _ in range(12):
        base = _prose(r, r.randint(40, 160)).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randint(0, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), "one two"), (len(rows) + 1, "One  two"), (len(rows) + 2, None), (len(rows) + 3, "")]
    want = _classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in neardup.classes(docs).collect()}
    assert [got[k]["class_id"] for k in range(len(rows))] == want
    assert [got[k]["class_size"] for k in range(len(rows))] == [want.count(c) for c in want]
    assert sorted(x["doc_id"] for x in neardup.keep_one(docs).collect()) == sorted(set(want))
    assert neardup.classes(none).count() == 0
    assert neardup.classes(odd).count() == odd.count()
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 1


def test_prob_minhash_estimates_probability_jaccard():
    r = np.random.default_rng(4)
    items = r.integers(1, 2**63, 300).astype(np.uint64)
    a = {int(x): float(w) for x, w in zip(items[:200], r.uniform(1, 4, 200), strict=True)}
    b = {int(x): float(w) for x, w in zip(items[60:260], r.uniform(1, 4, 200), strict=True)}
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a if d in b)
    owner = np.repeat([0, 1], [len(a), len(b)])
    s = neardup.prob_minhash(owner, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, m=4000)
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.04)
    assert (neardup.prob_minhash(owner[:200], np.array([*a], np.uint64), np.ones(200), 1, m=64) != 0).all()


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 400))
        x = r.integers(1, 2**63, n).astype(np.uint64)
        y = np.unique(np.concatenate([x[int(n * r.uniform(0, 0.3)) :], r.integers(1, 2**63, int(n * 0.1)).astype(np.uint64)]))
        x = np.unique(x)
        s = neardup.sketches(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
        assert np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {x["a"]: x["b"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for e in edges for n in e)


def test_spans_remove_shared_passages(spark, odd, none):
    r = random.Random(2)
    passage, loose = _prose(r, 60), _prose(r, 70).replace(".", "")
    clean = [_prose(r, 50) for _ in range(6)]
    rows = [(k, f"{c} {passage if k % 2 else loose} {_prose(r, 30)}") for k, c in enumerate(clean)] + [(50, clean[0] + " x"), (60, _prose(r, 90))]
    got = {x["doc_id"]: x for x in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == rows[0][1] and got[1]["text"] == rows[1][1] and got[60]["n_removed"] == 0
    for k in (2, 3, 4, 5):
        lost = set(words_of(rows[k][1])) - set(words_of(got[k]["text"]))
        assert got[k]["n_removed"] > 0 and lost <= set(words_of(passage + " " + loose))
        left = len(words_of(rows[k][1])) - len(words_of(got[k]["text"]))
        assert left >= 35
    assert spans.remove_repeats(none).count() == 0
    assert spans.remove_repeats(odd).count() == odd.count()


def test_spans_by_brute_force(spark):
    r = random.Random(12)
    pool = [_prose(r, 9) for _ in range(12)]
    rows = [(k, " ".join(r.choice(pool) for _ in range(8))) for k in range(40)]
    got = {x["doc_id"]: x["text"] for x in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen: dict = {}
    for k, text in rows:
        s = re.findall(r"[^.]+\.\s*", text)
        gone, here = set(), set()
        for i in range(len(s) - 2):  # nine words a sentence: three make a span
            key = " ".join("".join(s[i : i + 3]).split())
            if seen.setdefault(key, k) != k or key in here:
                gone |= {i, i + 1, i + 2}
            here.add(key)
        assert got[k] == "".join(x for i, x in enumerate(s) if i not in gone)


def test_mixing_meets_targets(spark, odd, none):
    r = random.Random(6)
    kinds = {0: WORDS[:6], 1: WORDS[6:11], 2: WORDS[11:]}
    rows, labels = [], []
    for k in range(240):
        y = (0, 0, 0, 1, 2)[k % 5]
        rows.append((k, " ".join(r.choice(kinds[y]) for _ in range(r.randint(5, 60)))))
        if k < 150:
            labels.append((k, int(y == 0), int(y == 2)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.rates(docs, table).collect()
    right = sum(max((0, 1, 2), key=lambda k: x[("p_good", "p_low", "p_toxic")[k]]) == (0, 0, 0, 1, 2)[x["doc_id"] % 5] for x in got if x["doc_id"] >= 150)
    assert right >= 85  # of 90 held out
    t = np.array([x["n_tokens"] for x in got], float)
    p = np.array([[x["p_good"], x["p_low"], x["p_toxic"]] for x in got]) / 1e6
    rate = np.array([x["rate"] for x in got]) / 1e6
    fitted = (t * rate) @ p
    assert np.allclose(fitted / fitted.sum(), [0.90, 0.07, 0.03], atol=2e-3) and (rate >= 0).all()
    assert all(x["n_copies"] >= 1 for x in got if x["p_good"] >= max(x["p_low"], x["p_toxic"]))
    assert abs(sum(x["n_copies"] * x["n_tokens"] for x in got) - fitted.sum()) < 0.15 * fitted.sum()
    assert mixing.mixed(docs, table).count() == sum(x["n_copies"] for x in got)
    assert mixing.rates(none, table).count() == 0
    assert mixing.rates(odd, table.limit(0)).count() == odd.count()
    assert mixing.mixed(odd, table).columns == odd.columns


@pytest.mark.parametrize("floors", [{}, {"a": 1.0}])
def test_rates_by_independent_least_squares(spark, floors):
    """Accelerated projected gradient in numpy on one rate a document, which knows nothing of duals."""
    r = np.random.default_rng(3)
    p = np.floor(r.dirichlet([0.5, 0.3, 0.3], 120) * 1e6).astype(int)
    p[:, 0] += 1_000_000 - p.sum(axis=1)
    t = r.integers(1, 500, 120)
    rows = spark.createDataFrame([(int(a), *map(int, b)) for a, b in zip(t, p, strict=True)], "_tokens long, _p0 long, _p1 long, _p2 long")
    changes, report = mixing.fit_rates(rows, {"a": 0.8, "b": 0.15, "c": 0.05}, floors=floors)
    target, q = report["target"], p / 1e6
    least = np.where((q[:, 0] >= q[:, 1]) & (q[:, 0] >= q[:, 2]), floors.get("a", 0.0), 0.0)
    lead = (t[:, None] * q) / target  # of squared misses in parts of targets
    size = np.linalg.norm(lead, 2) ** 2
    x = y = np.maximum(1.0, least)
    k = 1.0
    for _ in range(30_000):
        new = np.maximum(least, y - lead @ (lead.T @ y - 1) / size)
        k, before = (1 + (1 + 4 * k * k) ** 0.5) / 2, k
        x, y = new, new + (before - 1) / k * (new - x)
    own = np.maximum(least, 1 + (q @ changes[0] if changes else 0))
    assert np.abs((t * x) @ q / target - 1).max() < 2e-3  # the independent fit meets the targets,
    assert np.abs((t * own) @ q / target - 1).max() < 1e-3  # and so do the engine's rates,
    assert np.allclose((t * own) @ q, report["fitted"], rtol=1e-4) and (own >= least).all()
    assert (t * (own - 1) ** 2).sum() <= 1.01 * (t * (x - 1) ** 2).sum()  # which change no more
    assert report["target"].sum() >= report["current"].sum()


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(vocabulary):
    from tokenizers import Tokenizer

    own, lib = prefix_bpe.PrefixEncoder(open(vocabulary, encoding="utf-8").read()), Tokenizer.from_file(vocabulary)
    r = random.Random(1)
    texts = ["", " ", "</w>", "a</w>b", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "İ ǅ ß ẞ", "é ́x", "a b c\x1cd\x85e", "it's we'll I'D 's", "日本語", "a" * 300, "😀👍🏽", "ﬁ 각"]
    texts += ["".join(r.choice("aabbccdeeéèñ 's<>/w|\n\t1Σßz") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(0x80, 0x24F), r.randint(0x300, 0x36F), r.randint(0x370, 0x5FF)])) for _ in range(25)) for _ in range(300)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_over_rows(vocabulary, odd, none):
    out = prefix_bpe.encode_decode(odd, vocabulary).collect()
    assert len(out) == odd.count() and all(x["n_tokens"] == len(x["ids"]) for x in out)
    assert prefix_bpe.encode_decode(none, vocabulary, digests=True).count() == 0


def test_token_report_by_brute_force(spark, odd):
    r = random.Random(4)
    n = [0, 0, 5, 4096, 4097, 9000, *[r.randint(0, 9000) for _ in range(200)]]
    h = token_counts.length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))
    report = token_counts.context_report(h)
    for x in report.collect():
        c = x["context_limit"]
        assert (x["n_docs"], x["docs_within"], x["docs_above"]) == (n.count(c), sum(v <= c for v in n), sum(v > c for v in n))
        assert x["truncated_tokens"] == sum(min(v, c) for v in n) and x["tokens_lost"] == sum(n) - x["truncated_tokens"]
    assert token_counts.quantiles(report, [0.5]).first()["q0.5"] == sorted(n)[(len(n) - 1) // 2]
    assert token_counts.truncated_total(h, 777).first()[0] == sum(min(v, 777) for v in n)
    P = pytest.importorskip("public_tokenizers")
    lengths = token_counts.encoded_lengths(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id"])
    assert {x["n_tokens"] for x in lengths.filter("doc_id in (2, 3)").collect()} == {0}


def test_secrets(spark, odd, none):
    key = hashlib.sha1(b"x").hexdigest()
    rows = [
        (1, f'the client sends token = "{key}" to it', "en", "s", 1),
        (2, f"commit {key} fixed it", "en", "s", 1),
        (3, "see https://www.example.com/a/page12 for more", "en", "s", 1),
        (4, "password: hunter2!Zq and so on", "en", "s", 1),
        (5, 'token = "your_token_here_123456"', "en", "s", 1),
        (6, "-----BEGIN RSA PRIVATE KEY-----", "en", "s", 1),
        (7, "card 4785380592391139 is known", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = secrets.scan(docs).collect()
    text = {x[0]: x[1] for x in rows}
    assert all(hashlib.sha256(text[x["doc_id"]][x["begin"] : x["end"]].encode()).hexdigest() == x["value_sha256"] for x in got)
    assert {x["doc_id"] for x in got if x["is_secret"]} >= {1, 6} and not {x["doc_id"] for x in got if x["is_secret"]} & {2, 3, 5, 7}
    assert {x["doc_id"] for x in got} >= {1, 2, 4, 5, 6, 7}
    assert secrets.scan(none).count() == 0 and secrets.scan(odd).count() == 0


def test_secret_forest_held_out(spark):
    from pyspark.ml.functions import array_to_vector

    model = secrets.forest(spark)
    held = secrets.training_findings(600, seed=99)
    data = [(secrets.features(t[s:e], t[max(0, s - 48) : s], t[e : e + 48], p), y) for t, s, e, p, y in held]
    out = model.transform(spark.createDataFrame(data, "f array<double>, y int").withColumn("features", array_to_vector("f")))
    assert out.filter(F.col("prediction") == F.col("y")).count() >= 570


def test_licenses(spark, odd, none):
    rows = [(k, f"Some prose about a {w}.\n{t}\nAnd the end of it.", "en", "s", 1) for k, (w, t) in enumerate([("river", "Released under the MIT License."), ("stone", "Licensed under the Apache License, Version 2.0."), ("cloud", "This work is licensed under the GNU General Public License, version 3."), ("maple", "Licensed under CC BY-NC 4.0."), ("tiger", "He renewed his driver's license at the office last week."), ("ocean", "Er kam mit dem Auto und die Lizenz war weg."), ("violet", "The band owns the copyright of three songs from that year.")])]
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect() if x["confirmed"]}
    assert {k: x["family"] for k, x in got.items()} == {0: "MIT", 1: "Apache-2.0", 2: "GPL", 3: "CC-BY-NC"}
    assert all(x["place"] == 1 for x in got.values())
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == 0


def test_blocks_cover_all_texts(monkeypatch):
    monkeypatch.setattr(textvec, "BLOCK_BYTES", 50)
    texts = ["a b", None, "", "x" * 200, "é ü", " ", "last one"]
    got = {}
    for b in textvec.blocks(pa.array(texts)):
        s, e, d = b.words()
        for x, y, k in zip(s, e, d, strict=True):
            got.setdefault(int(k) + b.first, []).append(b.data[x:y].tobytes().decode())
    assert [got.get(k, []) for k in range(len(texts))] == [words_of(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_rates_reach_targets_of_a_scarce_domain(spark, seed):
    """Hardly a document of one domain: rates still change until the targets are met."""
    r = np.random.default_rng(seed)
    p = np.concatenate([r.dirichlet([30, 0.6, 0.3], 500), r.dirichlet([1, 30, 1], 1), r.dirichlet([5, 0.1, 6], 20)])
    p = np.floor(p * 1e6).astype(int)
    p[:, 0] += 1_000_000 - p.sum(axis=1)
    t = r.integers(50, 500, len(p))
    rows = spark.createDataFrame([(int(a), *map(int, b)) for a, b in zip(t, p, strict=True)], "_tokens long, _p0 long, _p1 long, _p2 long")
    changes, report = mixing.fit_rates(rows, {"good": 0.90, "low": 0.07, "toxic": 0.03}, floors={"good": 1.0})
    assert changes and np.abs(report["fitted"] / report["target"] - 1).max() < 0.02


@pytest.mark.parametrize("percent", [30, 40, 45])
def test_quality_rejects_the_junk_of_a_junk_heavy_group(spark, percent):
    r = random.Random(percent)
    rows = [(k, _prose(r, r.randint(60, 200)), "en", "s", 1) for k in range(300)]
    junk = 300 * percent // (100 - percent)
    rows += [(1000 + k, " ".join(w + "%%%" for w in _prose(r, r.randint(50, 90)).split()), "en", "s", 1) for k in range(junk)]
    got = {x["doc_id"]: x for x in quality.verdicts(quality.text_counts(spark.createDataFrame(rows, SCHEMA), ["doc_id", "lang", "source"])).collect()}
    assert sum(got[k]["kept"] for k in range(300)) >= 299 and not any(got[1000 + k]["kept"] for k in range(junk))


def test_near_duplicates_with_looped_phrases(spark):
    """Sets at 0.8 or more, of which one text repeats what the other holds once."""
    r = random.Random(21)
    rows = []
    for k in range(150):
        own = [f"w{k}x{i}" for i in range(200)]
        other = own[:184] + [f"v{k}x{i}" for i in range(16)]
        loop = own[20:30] if k % 3 else own[20:70]
        rows += [(2 * k, " ".join(own[:20] + loop * (1000 if k % 3 else 200) + own[20:])), (2 * k + 1, " ".join(other))]
    r.shuffle(rows)
    sets = {k: _set(t) for k, t in rows}
    want = {k: (k - k % 2 if len(sets[k] & sets[k ^ 1]) >= 0.8 * len(sets[k] | sets[k ^ 1]) else k) for k in sets}
    assert sum(v != k for k, v in want.items()) == 150
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_bands_of_equal_sets_do_not_depend_on_repeats():
    a = "one two three four five six seven eight nine"
    keys = [neardup.describe(b)[2:4] for b in tv_blocks([a, " ".join([a, a, a, a]), " ".join([a] * 40)])][0]
    assert (keys[0][1] == keys[0][2]).all() and (keys[1][1] != keys[1][2]).any() and (keys[0][0] == keys[1][0]).all()


def tv_blocks(texts):
    return textvec.blocks(pa.array(texts))


def test_short_and_embedded_licenses(spark):
    short = {"All rights reserved.": "Proprietary", "Copyright 2021 Sample Inc. All rights reserved.": "Proprietary", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "License: GPL-3.0": "GPL", "BSD 3-Clause License": "BSD", "MIT License": "MIT", "The river rose in the night. Licensed under CC BY 4.0. We walked along the shore for hours.": "CC-BY"}
    others = ["He renewed his driver's license at the office last week.", "The band owns the copyright of three songs from that year."]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate([*short, *others])]
    got = sorted((x["doc_id"], x["family"], x["confirmed"]) for x in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [*[(k, f, True) for k, f in enumerate(short.values())], (7, "unknown", False), (8, "unknown", False)]
