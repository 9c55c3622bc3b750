"""BPE encoding and decoding by prefix-sharing trie traversal.

A text is normalised and cut into pieces as the tokenizer file says; BPE works on each piece alone. The distinct pieces of
a batch that the worker hasn't met yet go into a trie. The walk is depth first; a node's state is the last token of the BPE encoding of the
prefix that it stands for, and the state of the prefix before that token. BPE has one property that makes this enough:
a sequence of tokens is an encoding exactly if each two neighbours are, so a prefix's last token is the one token that ends it and
agrees with the last token of what comes before. A prefix shared by many words is so encoded once.

Nothing is shuffled: the vocabulary is a file of fixed size, read once a worker, and each task's table of
pieces (and of pairs of tokens) is bounded, then started afresh.

The tokenizer file is a parameter. Supported: BPE without dropout, unknown token and byte fallback, over byte symbols, with or without an end-of-word
suffix; added tokens that are special and not normalised are found in the raw text first. A file that asks for more is refused.

Defined cases: a null text is empty, with no tokens and an empty decoded text; repeated rows are encoded each for itself; very long texts and pieces cost in
proportion to their length times the longest token; of two equal merges the left one goes first; extra columns, also of clashing names, pass through encode_documents(), where new
columns take the place of old ones with their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalgrid.llm.common import arrow_batches, table

FILE = "word_bpe_49k.json"
CACHE_PIECES = 400_000
CACHE_PAIRS = 300_000
#: White space as Unicode has it.
SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256."""
    printing = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


class Bpe:
    """A tokenizer file's encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:  # a vocabulary installed on every machine, not an input
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("unsupported model")
        if spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("unsupported decoder or post-processor")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("unsupported added token")
        self.token = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = {s["type"]: s for s in spec["normalizer"]["normalizers"]}
        if set(steps) != {"NFC", "Replace", "Lowercase"} or steps["Replace"]["content"] != " " or steps["Replace"]["pattern"] != {"Regex": "\\s+"}:
            raise ValueError("unsupported normalizer")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("unsupported pre-tokenizer")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE))
        self.symbol = dict(enumerate(byte_symbols()))
        self.halves: dict[str, tuple[str, str] | None] = {}  # the merge that makes a token; None for a symbol
        # Tokens within a piece and those that end one, by their characters; and how long they get, by their last character.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t, i in self.vocabulary.items():
            ends = bool(self.end) and t.endswith(self.end) and t != self.end
            body = t[: -len(self.end)] if ends else t
            symbols = (*body[:-1], body[-1] + self.end) if ends else tuple(body)
            whole, last = self.merge(symbols)
            if whole == [t]:  # others can't come up
                (self.final if ends else self.inner)[body] = i
                self.halves[t] = last
        if not self.end:
            self.final = self.inner
        self.reach_inner, self.reach_final = ({}, {})
        for tokens, reach in ((self.inner, self.reach_inner), (self.final, self.reach_final)):
            for t in tokens:
                reach[t[-1]] = max(reach.get(t[-1], 0), len(t))
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.agrees: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}

    def merge(self, symbols: Iterable[str]) -> tuple[list[str], tuple[str, str] | None]:
        """BPE as defined: merge the pair of the lowest rank, leftmost first, until none has a rank. (What is left, the last merge)."""
        out, last = list(symbols), None
        while len(out) > 1:
            best = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(out, out[1:], strict=False)))
            if best[0] == len(self.rank):
                break
            last = (out[best[1]], out[best[1] + 1])
            out[best[1] : best[1] + 2] = ["".join(last)]
        return out, last

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stood at a token's right (1) or left (0) edge as it was merged: (token, rank of the merge that ended it), the token itself last in time."""
        key = (token, side)
        found = self.edges.get(key)
        if found is None:
            found, until, now = [], len(self.rank), token
            while now is not None:
                found.append((now, until))
                halves = self.halves[now]
                if halves is None:
                    break
                until, now = self.rank[halves], halves[side]
            self.edges[key] = found
        return found

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the symbols of both tokens together are encoded as these two: no merge across the edge comes while both its parts stand there. Of equal
        ranks the left one goes first."""
        found = self.agrees.get((a, b))
        if found is None:
            left, right, rank = self.edge(self.token[a], 1), self.edge(self.token[b], 0), self.rank
            found = True
            for x, before in left:
                for y, upto in right:
                    r = rank.get((x, y))
                    if r is not None and r < before and r <= upto:
                        found = False
            self.agrees[a, b] = found
        return found

    def last_token(self, text: str, n: int, path: list[tuple[int, int]], tokens: dict[str, int], reach: dict[str, int]) -> tuple[int, int]:
        """(last token of the encoding of text[:n], its length): the one token that ends it and agrees with what comes before."""
        for size in range(min(n, reach.get(text[n - 1], 0)), 0, -1):
            token = tokens.get(text[n - size : n])
            if token is not None and (n == size or self.neighbours(path[n - size - 1][0], token)):
                return token, size
        raise ValueError(f"no token ends {text[:n]!r}")

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodings of new pieces: sorted pieces are a trie's depth-first order, path holds the states from the root to where the walk is."""
        path: list[tuple[int, int]] = []  # of each prefix that doesn't end a piece
        before = ""
        for text, piece in sorted(("".join([self.symbol[b] for b in p.encode()]), p) for p in pieces):
            most, shared = min(len(path), len(text) - 1), 0
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del path[shared:]
            before = text
            for n in range(shared + 1, len(text)):
                path.append(self.last_token(text, n, path, self.inner, self.reach_inner))
            token, size = self.last_token(text, len(text), path, self.final, self.reach_final)
            ids, at = [token], len(text) - size
            while at:
                token, size = path[at - 1]
                ids.append(token)
                at -= size
            ids.reverse()
            self.known[piece] = (len(ids), " ".join(map(str, ids)), " ".join([self.token[i] for i in ids]))

    def normal(self, text: str) -> str:
        """NFC, then each character in lower case by itself."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def cut_text(self, text: str) -> list[str]:
        """The pieces in order; special tokens as they are."""
        if self.cut is None or not self.cut.search(text):
            return self.pieces.findall(self.normal(text))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.pieces.findall(self.normal(text[at : m.start()]))
            out.append(m.group())
            at = m.end()
        return out + self.pieces.findall(self.normal(text[at:]))

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each text. A token's string is looked up by id, so the decoded text comes from the ids."""
        cut = [self.cut_text(t) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        if len(self.agrees) > CACHE_PAIRS:
            self.agrees = {}
        new = {p for pieces in cut for p in pieces} - self.known.keys()
        self.learn(new - self.special.keys())
        self.known |= {t: (1, str(i), t) for t, i in self.special.items()}
        out = []
        for pieces in cut:
            found = [self.known[p] for p in pieces]
            out.append((sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.token[i] for i in ids])


@cache
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def vocabulary_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(path: str | None, output: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or vocabulary_path())
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            done = []
            for at in range(0, len(texts), 256):
                for n, ids, decoded in bpe.encode_batch(texts[at : at + 256]):
                    if output == "ids":
                        done.append((n, np.fromstring(ids, np.int32, sep=" "), decoded))
                    else:
                        done.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            kind = pa.list_(pa.int32()) if output == "ids" else pa.string()
            columns = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], kind), pa.array([d[2] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "n", "a", "b"])
        bpe.known = {}  # an idle worker keeps none

    return run


def encode_rows(rows: DataFrame, path: str | None = None, output: str = "ids") -> DataFrame:
    """The fields of row (a struct) with n_tokens and, for output "ids", token_ids and decoded; for "digests", ids_sha256 and decoded_sha256. rows: row and text."""
    arrow_batches(rows.sparkSession, megabytes=8)
    names = {"ids": ("token_ids", "decoded"), "digests": ("ids_sha256", "decoded_sha256")}[output]
    kind = T.ArrayType(T.IntegerType()) if output == "ids" else T.StringType()
    schema = T.StructType([rows.schema["row"], T.StructField("n", T.LongType()), T.StructField("a", kind), T.StructField("b", T.StringType())])
    out = rows.select("row", "text").mapInArrow(_encode(path, output), schema)
    return out.select("row.*", F.col("n").alias("n_tokens"), F.col("a").alias(names[0]), F.col("b").alias(names[1]))


def encode_documents(docs: DataFrame, path: str | None = None, output: str = "ids") -> DataFrame:
    """docs with the columns of encode_rows(), which replace old ones of their names. The row travels as one value, so that its columns' names can't clash with ours."""
    new = ("n_tokens", "token_ids", "decoded") if output == "ids" else ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode_rows(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("row"), F.col("text")), path, output)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_rows(table(spark, sf_dir, "documents").select(F.struct("doc_id").alias("row"), "text"), output="digests")


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
