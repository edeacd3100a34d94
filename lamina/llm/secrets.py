"""Operator 1: secret scan with a random forest that removes false positives.

Candidates are all runs of 16 or more characters of [A-Za-z0-9+/=_-.~] with a digit, all values of 6
or more characters that are assigned (with = or :) to a name that ends in a cue like `token` or
`password`, and headers of private keys. Each has a vector of features: length, transitions between
kinds of characters and between letters, the share covered by dictionary words, the path, and the
words beside it. A random forest, trained from labelled findings, gives the probability of a secret.

The dictionary is the words below and, with a vocabulary file of a public tokenizer, its entries of
LEAST_ENTRY letters or more that end a word: some 25,000 words whose number doesn't grow with the data.

Labelled findings are rows (text, begin, end, path, label); without a table of them, a generated one
of TRAINING rows is used: random keys in usual formats against hashes, identifiers, addresses,
placeholders and the like.

Null and empty texts have no candidates; a null path counts as empty. Candidates of any length are
whole, in texts of any length; any number of blanks may stand beside a sign. Repeated rows give repeated
findings; of candidates that begin together the first found stays; a score of just the threshold is a
secret. An empty table gives an empty result. Other columns of any name don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import textvec as tv
from lamina.llm.shared import ship

#: Rows of generated findings, trees and their depth, least probability of a secret.
TRAINING, TREES, DEPTH, THRESHOLD = 3000, 40, 8, 0.5
LEAST_RUN, LEAST_VALUE = 16, 6
#: Least letters of a word of the dictionary, and of an entry of a vocabulary (shorter ones are often word ends).
LEAST_WORD, LEAST_ENTRY = 4, 5
#: Bytes beside a candidate that are looked at for words.
CONTEXT = 48

#: Names that values are assigned to, words that speak for and against a secret, and
#: parts of paths that speak against.
CUES = "token secret password passwd pwd apikey api_key api-key access_key private_key auth credential bearer".split()
FOR = {*CUES, "key", "authorization", "login", "client", "aws", "account"}
AGAINST = set("example sample dummy test placeholder sha sha1 sha256 md5 hash checksum commit digest uuid guid id revision version http https www url isbn build etag your changeme redacted".split())
PATHS = ("test", "example", "sample", "fixture", "doc", "mock", "lock", "sum")
#: Frequent English words, for coverage and for letter transitions.
WORDS = """the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who
boy did its let put say she too use about after again also back because been before being between both call came come could each even
every find first from give good great hand have here high home house into just keep kind know large last late life like line little
long look made make many more most move much must name need never next number only open order other over own page part people place
point read right same school second seem sentence service set should show small some sound still such system take tell than that their
them then there these they thing think this those through time turn under until upon value very want water well went were what when
where which while will with word work world would write year your account address admin array base buffer build cache class client code
config connection content count create data database date debug default delete demo error event example field file filter format
function group handler hash image index input item json key length level library list local login manager message method model module
null object option output package param password path process project property query record request response result return root
sample schema script secret server session setting source start state status string style table template test text title token type
update upload user util version view""".split()

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-.~"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ASSIGN = np.zeros(256, bool)
_ASSIGN[list(b"=:")] = True
_VALUE = re.compile(rb"[\"']?([^\s\"']+)")
_NAMED = tuple(c.encode() for c in CUES)
_HEADER = re.compile(rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
_LONGEST = max(map(len, CUES))
_TOKENS = re.compile(r"[A-Za-z][A-Za-z0-9]*")


class Dictionary:
    """Words that cover a value, and how well its letters follow each other as in the words."""

    def __init__(self, more: tuple[str, ...] = ()):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        n = np.ones((27, 27))
        for w in dict.fromkeys([*WORDS, *more]):
            if len(w) >= LEAST_WORD:
                self._automaton.add_word(w, len(w))
            codes = _codes(f" {w} ")
            for a, b in zip(codes, codes[1:], strict=False):
                n[a, b] += 1
        self._automaton.make_automaton()
        self._letters = np.log(n / n.sum(axis=1, keepdims=True))

    def coverage(self, lower: str) -> float:
        """The share of characters in words, longest and leftmost first, none in two words."""
        return sum(size for _, size in self._automaton.iter_long(lower)) / max(1, len(lower))

    def letter_score(self, lower: str) -> float:
        """The mean logarithm of the letters' transitions."""
        codes = _codes(lower)
        return float(np.mean(self._letters[codes[:-1], codes[1:]])) if len(lower) > 1 else 0.0


def _codes(lower: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else 0 for c in lower]


@functools.lru_cache(maxsize=2)
def dictionary_of(more: tuple[str, ...] = ()) -> Dictionary:
    """One dictionary for each list of words and process."""
    return Dictionary(more)


def entries(vocabulary: str | None) -> tuple[str, ...]:
    """The words of a tokenizers file whose entries mark the ends of words; none without a file."""
    if vocabulary is None:
        return ()
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    words = {name[: len(name) - len(end)].lower() for name in model["vocab"] if end and name.endswith(end)}
    return tuple(sorted(w for w in words if len(w) >= LEAST_ENTRY and w.isascii() and w.isalpha()))


FEATURES = ["length", "entropy", "digits", "upper", "lower", "symbols", "hex", "kind_changes", "letter_score", "dictionary", "distinct", "assigned", "quoted", "cue_before", "words_for", "words_against", "path_against", "path_depth", "dots", "dashes"]


def features(value: str, before: str, after: str, path: str, dictionary: Dictionary | None = None) -> list[float]:
    """The FEATURES of a candidate; without a dictionary, that of WORDS alone counts."""
    dictionary = dictionary or dictionary_of()
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    counts = {c: value.count(c) for c in set(value)}
    lower = value.lower()
    names = [w.lower() for w in _TOKENS.findall(before)][-5:]
    near = {*names, *[p for w in names for p in re.split(r"[_\-.]", w)], *[w.lower() for w in _TOKENS.findall(after)][:3]}
    tail = before.rstrip()
    assigned = tail.rstrip("\"'").rstrip()[-1:] in ("=", ":")
    last = names[-1] if names else ""
    where = path.lower()
    return [
        math.log(n),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        *[kinds.count(k) / n for k in "duls"],
        float(re.fullmatch(r"[0-9a-f]+", lower) is not None),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        dictionary.letter_score(lower),
        dictionary.coverage(lower),
        len(counts) / min(n, 64),
        float(assigned),
        float(tail[-1:] in ("\"", "'")),
        float(any(c in last or last.endswith(c) for c in CUES)) if last else 0.0,
        float(len(near & FOR)),
        float(len(near & AGAINST)),
        float(sum(p in where for p in PATHS)),
        float(where.count("/")),
        value.count(".") / n,
        value.count("-") / n,
    ]


def candidates(b: tv.Block) -> list[tuple[int, int, int, str]]:
    """(text, begin, end, kind) of a block, as byte places within the block."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    starts, ends, doc = b.spans(_RUN[b.data])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[b.data])])
    ok = (ends - starts >= LEAST_RUN) & (digits[ends] > digits[starts])
    for s, e, d in zip(starts[ok].tolist(), ends[ok].tolist(), doc[ok].tolist(), strict=True):
        raw = b.data[s:e].tobytes()
        core = raw[raw.rstrip(b"=").rfind(b"=") + 1 :]  # of name=value the value
        end = e - (len(core) - len(core.rstrip(b".~")))
        if end - (e - len(core)) >= LEAST_RUN:
            found[e - len(core), end] = (d, "run")
    signs = np.flatnonzero(_ASSIGN[b.data])
    owner = np.searchsorted(b.offsets, signs, "right") - 1
    solid = np.flatnonzero(~tv._SPACE[b.data]) if len(signs) else signs  # whatever blanks are beside a sign
    before, after = np.searchsorted(solid, signs) - 1, np.searchsorted(solid, signs) + 1
    for k, d in enumerate(owner.tolist()):
        low, high = int(b.offsets[d]), int(b.offsets[d + 1])
        till = int(solid[before[k]]) + 1 if before[k] >= 0 else 0
        at = int(solid[after[k]]) if after[k] < len(solid) else high
        name = b.data[max(low, till - 1 - _LONGEST) : max(low, till)].tobytes().lower()
        if (name[:-1] if name[-1:] in (b'"', b"'") else name).endswith(_NAMED) and at < high:
            size = 256
            while (value := _VALUE.match(b.data[at : min(high, at + size)].tobytes())) and value.end() == size and at + size < high:
                size *= 4
            if value and value.end(1) - value.start(1) >= LEAST_VALUE:
                s, e = at + value.start(1), at + value.end(1)
                while e > s and b.data[e - 1] in b".,;)]}":
                    e -= 1
                if not any((s, x) in found for x in range(e - 4, e + 4)) and e - s >= LEAST_VALUE:
                    found[s, e] = (d, "assigned")
    for m in _HEADER.finditer(b.data.tobytes()):
        d = int(np.searchsorted(b.offsets, m.start(), "right")) - 1
        if m.end() <= b.offsets[d + 1]:
            found[m.start(), m.end()] = (d, "private_key")
    return [(d, s, e, kind) for (s, e), (d, kind) in sorted(found.items())]


def _beside(b: tv.Block, d: int, s: int, e: int) -> tuple[str, str, str]:
    text = lambda x, y: b.data[x:y].tobytes().decode("utf-8", "ignore")
    return text(s, e), text(max(int(b.offsets[d]), s - CONTEXT), s), text(e, min(int(b.offsets[d + 1]), e + CONTEXT))


def training_findings(n: int = TRAINING, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """Generated labelled findings: (text, begin, end, path, label)."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: r.choice(WORDS)
    prose = lambda k: " ".join(word() for _ in range(r.randint(0, k)))
    keys = [lambda: pick(hexa, r.choice((32, 40, 64))), lambda: pick(alnum, r.randint(20, 44)), lambda: "AKIA" + pick(alnum.upper(), 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 40), lambda: pick(alnum + "+/", 43) + "=", lambda: "eyJ" + pick(alnum, 24) + "." + pick(alnum, 40) + "." + pick(alnum + "-_", 40), lambda: pick(alnum + "!@$%", r.randint(10, 18))]
    names = [*CUES, "client_secret", "access_token", "auth_token", "SECRET_KEY", "db_password", "TOKEN", "API_KEY"]
    innocent = [
        lambda: (r.choice(("commit ", "sha1 ", "sha256: ", "md5: ", "checksum ", "digest = ", "etag: ", "revision ")), pick(hexa, r.choice((32, 40, 64)))),
        lambda: (r.choice(("uuid ", "id = ", "guid: ", "request id ")), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (r.choice(("see ", "http://", "url: ", "https://")), f"www.{word()}{word()}.com/{word()}/{word()}{r.randint(1, 99)}"),
        lambda: (r.choice(("call ", "", "def ")), "_".join(word() for _ in range(r.randint(3, 5))) + str(r.randint(1, 99))),
        lambda: (f"{r.choice(names)} = \"", r.choice(("your_token_here_123456", "xxxxxxxxxxxxxxxx1234", "changeme123", "example_password_1", "<redacted-secret-1>", "EXAMPLE_KEY_0000000000", "password123456", "test_token_123456789"))),
        lambda: ("on ", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T0{r.randint(0, 9)}:00"[:16] + pick("0123456789", 3)),
        lambda: (r.choice(("order ", "phone ", "card ", "isbn ", "")), pick("0123456789", r.randint(16, 20))),
        lambda: ("mail ", f"{word()}.{word()}{r.randint(1, 99)}.{word()}.com"),
        lambda: (r.choice(("", "build ", "version ")), f"{word()}-{word()}-{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}-{word()}"),
        lambda: ("", "".join(word() for _ in range(4)) + str(r.randint(0, 9))),
    ]
    out = []
    for k in range(n):
        path, before, after = r.choice(("src/app/config.py", "", "src12", "etc/settings.env", "lib/client.js")), prose(6), prose(6)
        if k % 2:
            value = r.choice(keys)()
            lead = f"{r.choice(names)}{r.choice((' = ', '=', ': ', ' : '))}{r.choice(('', chr(34), chr(39)))}" if r.random() < 0.9 or value[:3] not in ("AKI", "ghp", "sk-", "eyJ") else " "
        else:
            lead, value = r.choice(innocent)()
            if r.random() < 0.3:
                path = r.choice(("tests/fixtures/data.txt", "docs/example.md", "package.lock", "go.sum"))
        head = f"{before} {lead}" if before else lead
        tail = "\"" if lead.endswith("\"") else "'" if lead.endswith("'") else ""
        out.append((f"{head}{value}{tail} {after}", len(head), len(head) + len(value), path, k % 2))
    return out


def forest(spark: SparkSession, labelled: DataFrame | None = None, more: tuple[str, ...] = ()):
    """A random forest fitted on labelled findings, in one partition so that it is the same
    wherever it is fitted. labelled: (text, begin, end, path, label), at most TRAINING rows are
    taken, those with the least hashes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    if labelled is None:
        rows = training_findings()
    else:
        names = ["text", "begin", "end", "path", "label"]
        rows = [tuple(x) for x in labelled.select(*names).orderBy(F.xxhash64(*names), *names).limit(TRAINING).collect()]
    dictionary = dictionary_of(more)
    data = [(features(t[s:e], t[max(0, s - CONTEXT) : s], t[e : e + CONTEXT], p or "", dictionary), float(y)) for t, s, e, p, y in rows]
    table = spark.createDataFrame(data, "f array<double>, label double").coalesce(1).select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt").fit(table)


def find_candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, begin, end, value_sha256, f): places are code points; the value itself is not
    carried on."""
    ship(docs.sparkSession)
    kind_of_id = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        dictionary = dictionary_of(more)
        for batch in batches:
            paths = batch.column(1)
            who, rows = [], []
            for b in tv.blocks(batch.column(2)):
                points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
                for d, s, e, kind in candidates(b):
                    value, before, after = _beside(b, d, s, e)
                    zero = points[b.offsets[d]]
                    who.append(d + b.first)
                    rows.append((kind, int(points[s] - zero), int(points[e] - zero), hashlib.sha256(value.encode()).hexdigest(), features(value, before, after, paths[d + b.first].as_py() or "", dictionary)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *map(pa.array, columns, kinds)], names=["_id", "kind", "begin", "end", "value_sha256", "f"])

    path = F.col(path_column).cast("string") if path_column in docs.columns else F.lit("")
    source = docs.select(F.col(id_column).alias("_id"), path.alias("_path"), F.col(text_column).cast("string").alias("_text"))
    return source.mapInArrow(run, f"_id {kind_of_id}, kind string, begin long, end long, value_sha256 string, f array<double>")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source", threshold: float = THRESHOLD, vocabulary: str | None = None) -> DataFrame:
    """Every candidate with its probability (rounded to 6 places) and is_secret. Headers of
    private keys are secrets whatever the forest says. vocabulary: path of a tokenizers file, read
    by the driver, for the dictionary."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    more = entries(vocabulary)
    model = forest(docs.sparkSession, labelled, more)
    found = find_candidates(docs, id_column, text_column, path_column, more)
    scored = model.transform(found.withColumn("features", array_to_vector("f")))
    p = F.when(F.col("kind") == "private_key", F.lit(1.0)).otherwise(F.round(vector_to_array("probability")[1], 6))
    return scored.select(F.col("_id").alias(id_column), "kind", "begin", "end", "value_sha256", p.alias("score")).withColumn("is_secret", F.col("score") >= threshold)
