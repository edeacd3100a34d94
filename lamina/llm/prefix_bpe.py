"""Operator 8: BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word, exactly one token can be the last of the prefix's encoding. An
automaton over all tokens lists those that end at each position; a candidate is the one if it is
compatible with the last token of the prefix before it, that is, if running the merges on the two
would leave just these two. Following the stored tokens back from the end gives the exact ids.
One pass, linear in the word's length, whatever the merges do.

Null texts count as empty and have no ids; texts without tokens decode to the empty string; long
texts are worked on in slices that end at white space, and long words need memory in proportion to
their length only. Results are sent on as soon as there are SEND_BYTES of them. There are no ties: a prefix has one last token.
Repeated rows have equal ids. An empty table gives an empty result. Other columns are not looked at,
whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import give_back, named, ship

#: Words and pieces kept with their ids by each worker, and the longest kept.
CACHE_WORDS, CACHE_PIECES, CACHE_BYTES = 100_000, 100_000, 64
#: Characters (or ids) of a text that are worked on, and bytes of results that are sent, at a time.
SLICE, SEND_BYTES = 1 << 16, 1 << 20

_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_BLANK = re.compile(r"[\x20\x09-\x0d]")
#: What str.split() takes for white space, unlike the tokenizers' patterns.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Runs of printable ASCII and Latin-1 letters, which composition leaves alone and lower case maps
#: one to one; for these the usual word pattern is short.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The normalizers and the word pattern for which that short cut holds.
_USUAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_USUAL_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_FINAL = 0xE000
_NEVER = 1 << 60
_PACK = [struct.Struct(f"<{n}I") for n in range(33)]


class _Words(dict):
    """Words and their ids; asks for those it hasn't."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        return self.ask(word)


class PrefixEncoder:
    """Encodes and decodes with the vocabulary of a tokenizers file whose model is BPE."""

    def __init__(self, spec: str):
        import ahocorasick
        from tokenizers import Tokenizer

        parts = json.loads(spec)
        model = parts["model"]
        off = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")}
        if model["type"] != "BPE" or any(off.values()) or parts.get("decoder") or any(x.get(k) for x in parts["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError(f"this kind of tokenizer is not handled: {off}")
        # for its normalizer and its word pattern only, so without vocabulary
        self._library = Tokenizer.from_str(json.dumps(parts | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self._suffix = model.get("end_of_word_suffix") or ""
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self._usual = (parts.get("normalizer") or {}).get("normalizers") == _USUAL and steps[0].get("pattern") == {"Regex": _USUAL_PATTERN} and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self._high = {c: self._library.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7} if self._usual else {}
        vocab = model["vocab"]
        self.names = [""] * (1 + max([*vocab.values(), *(x["id"] for x in parts["added_tokens"])]))
        for name, i in vocab.items():
            self.names[i] = name
        self._special = {}
        for x in parts["added_tokens"]:
            self.names[x["id"]] = x["content"]
            self._special[x["content"]] = x["id"]
        self._split = re.compile("(" + "|".join(sorted(map(re.escape, self._special), key=len, reverse=True)) + ")") if self._special else None

        self.rank, self.merge, self._left, self._right = {}, {}, {}, {}
        made = set()
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            if i in made:
                raise ValueError(f"two merges make token {i}")
            made.add(i)
            self.rank[i], self._left[i], self._right[i] = r, vocab[a], vocab[b]
            self.merge[vocab[a], vocab[b]] = r
            if max(self.rank.get(vocab[a], -1), self.rank.get(vocab[b], -1)) >= r:
                raise ValueError(f"token {i} is made before its parts")
        units: dict[int, str] = {}
        for name, i in vocab.items():
            if i not in made:
                core = name[: -len(self._suffix)] if self._suffix and name.endswith(self._suffix) else name
                units[i] = name if len(name) == 1 else chr(_FINAL + ord(core)) if len(core) == 1 and core != name else ""
        for i in sorted(made, key=self.rank.get):
            units[i] = units[self._left[i]] + units[self._right[i]]
        self._automaton = ahocorasick.Automaton()
        for i, u in units.items():
            if u:
                self._automaton.add_word(u, (i, len(u)))
        self._automaton.make_automaton()
        self._right_spines: dict[int, list] = {}
        self._left_spines: dict[int, list] = {}
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._words = _Words(self._word)

    def _spine(self, token: int, child: dict[int, int], kept: dict[int, list]) -> list[tuple[int, int]]:
        """The tokens at one edge of a token while it is built, each with the rank of the merge
        that uses it up."""
        out = kept.get(token)
        if out is None:
            out, x, used = [], token, _NEVER
            while True:
                out.append((x, used))
                if x not in child:
                    break
                used, x = self.rank[x], child[x]
            kept[token] = out
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they are when b follows a.

        Parts are always made before the whole, so a merge across the border happens if it comes
        before both edge tokens are used up. Of equal merges the leftmost comes first.
        """
        out = True
        for x, used_x in self._spine(a, self._right, self._right_spines):
            for y, used_y in self._spine(b, self._left, self._left_spines):
                r = self.merge.get((x, y))
                if r is not None and r < used_x and r <= used_y:
                    out = False
        if len(self._fits) > 2 * CACHE_PIECES:
            self._fits.clear()
        self._fits[a << 32 | b] = out
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece (byte-level characters), which ends a word."""
        text = piece[:-1] + chr(_FINAL + ord(piece[-1])) if self._suffix else piece
        last: list[int] = [-1] * (len(text) + 1)
        back = [0] * (len(text) + 1)
        last[0], known, fits = 0, self._fits, self.fits
        for end, (token, size) in self._automaton.iter(text):
            at = end + 1
            if last[at] < 0:
                before = at - size
                a = last[before]
                if before == 0 or a >= 0 and (known[k] if (k := a << 32 | token) in known else fits(a, token)):
                    last[at], back[at] = token, before
        at, ids = len(text), []
        while at:
            if last[at] < 0:
                raise ValueError(f"no token ends at {at} of {piece[:80]!r}")
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _piece(self, piece: str) -> bytes:
        out = self._pieces.get(piece)
        if out is None:
            ids = self.encode_piece(piece)
            out = _PACK[len(ids)].pack(*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
            if len(piece) <= CACHE_BYTES:
                if len(self._pieces) >= CACHE_PIECES:
                    self._pieces.clear()
                self._pieces[piece] = out
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a run without white space, as little-endian 32-bit numbers."""
        if self._usual and _PLAIN.fullmatch(word) and not (self._split and self._split.search(word)):
            pieces = _PLAIN_PIECES.findall(word.lower())
            if not word.isascii():
                pieces = [p.translate(self._high) for p in pieces]
            return self._keep(word, [self._piece(p) for p in pieces])
        out = []
        for part in self._split.split(word) if self._split else [word]:
            if part in self._special:
                out.append(self._special[part].to_bytes(4, "little"))
            elif part:
                plain = self._library.normalizer.normalize_str(part) if self._library.normalizer else part
                out += [self._piece(p) for p, _ in self._library.pre_tokenizer.pre_tokenize_str(plain) if p]
        return self._keep(word, out)

    def _keep(self, word: str, parts: list[bytes]) -> bytes:
        ids = parts[0] if len(parts) == 1 else b"".join(parts)
        if len(word) <= CACHE_BYTES:
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            self._words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit numbers. No rule of the tokenizer looks
        across white space, so each run between white space is encoded once and remembered."""
        ask = self._words.__getitem__
        return b"".join([b"".join(map(ask, _WORD.findall(part) if _SEPARATORS.search(part) else part.split())) for part in slices(text)])

    def decode(self, ids: bytes) -> str:
        names = self.names
        return " ".join([" ".join([names[i] for i in np.frombuffer(ids[k : k + 4 * SLICE], "<u4").tolist()]) for k in range(0, len(ids), 4 * SLICE)])


def slices(text: str) -> Iterator[str]:
    """The text in parts of SLICE characters or more, each but the last up to a blank."""
    begin = 0
    while len(text) - begin > SLICE and (found := _BLANK.search(text, begin + SLICE)):
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:] if begin else text


_ENCODERS: dict[int, PrefixEncoder] = {}


def encoder_of(spec: str) -> PrefixEncoder:
    """One encoder for each vocabulary and worker process."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(spec)
        give_back()  # what the file's parts took
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """Row by row: the ids of each text and the text they decode to.

    vocabulary: path of a tokenizers file, read by the driver. Columns: the id column, n_tokens
    and ids (array) and decoded, or with `digests` ids_sha256 and decoded_sha256 instead.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()

    def results(who: pa.Array, all_ids: list[bytes], texts: list[str]) -> pa.RecordBatch:
        n = np.array([len(x) // 4 for x in all_ids], np.int64)
        if digests:
            made = [pa.array([hashlib.sha256(x).hexdigest() for x in all_ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts])]
        else:
            edge = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(all_ids))])
            made = [pa.ListArray.from_arrays(edge, flat), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([who, pa.array(n), *made], names=names)

    def run(batches):
        coder = encoder_of(spec)
        for batch in batches:
            begin, all_ids, texts, size = 0, [], [], 0
            for i, text in enumerate(batch.column(1)):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                size += len(ids) + len(decoded)
                all_ids.append(ids)
                texts.append(decoded)
                if size >= SEND_BYTES or i + 1 == batch.num_rows:
                    yield results(batch.column(0).slice(begin, len(texts)), all_ids, texts)
                    begin, all_ids, texts, size = i + 1, [], [], 0
        give_back()

    names = [id_column, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kind = docs.select(named(id_column)).schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(named(id_column), named(text_column).cast("string").alias("text")).mapInArrow(run, schema)
