"""Secrets in texts: three patterns, and a token-efficiency test for random strings (operator 7).

A vocabulary learned from text spends few tokens on words and many on noise. A string counts as
random where it has at most ``MAX_RATIO`` characters per token of a tiktoken vocabulary. Random strings
of letters and digits have 1.1 to 1.7; even invented words have 1.9 and more. Runs of at least
``LEAST_PART`` characters of the alphabets secrets are written in are tested

* as a whole (from ``MIN_RUN`` characters on), and where that is not random,
* in windows of ``LEAST_PART`` to ``MIN_RUN + 4`` characters, so words that are tied to a secret do not dilute it;
  windows that meet make one find, which is widened to the whole parts (between ``_ - / = +``) it
  is in, and narrowed by words at its ends.

Excluded, as runs, parts or windows, are

* digests that are known for what they are: those the caller lists, those of the empty text, and 32, 40, 56, 64, 96 or
  128 hexadecimal digits after a word that names them (``sha256:``, ``commit``, ``md5=``),
* identifiers: UUIDs, numbers, and names whose parts between ``_ - / . = +`` are letters in one case
  followed by digits at most (``part_0012``, ``model-v2``).

Texts are scanned whole, by numpy-free Arrow kernels first: only texts with a place where some
pattern can match reach Python's patterns. Places are code points, ends are exclusive.

Edge cases: null and empty texts have no spans. Overlapping spans of different kinds all stay;
redaction merges them. Rows with equal ids are scanned one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.llm.rowmaps import add_columns

KINDS = ("assign", "access", "hex", "random")  # in the order of their listing
MIN_RUN = 20
LEAST_PART = 16
MAX_RATIO = 1.75
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_PART},}}")

#: Where none of these matches, no pattern above can; the linear-time engine of Arrow looks for them.
_SIEVES = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    r"AKIA[A-Z0-9]{16}",
    rf"[A-Za-z0-9+/_=-]{{{LEAST_PART}}}",  # holds the runs of 24 hexadecimal digits too
)

_DIGEST = re.compile(r"[0-9a-fA-F]+")
_DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
_EMPTY_DIGESTS = frozenset(hashlib.new(name).hexdigest() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))
#: What stands before a digest that is named as one.
_NAMED = re.compile(r"""(?ai:\b(md5|sha-?(1|224|256|384|512)?|digest|checksum|commit|etag)(sums?)?)["']?\x20*[:=/_-]?\x20*["']?\Z""")
_BEFORE = 24  # characters looked at for such a name
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_UUID_INSIDE = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])")
_SOLID = re.compile(r"[A-Za-z0-9]+")
_BETWEEN = re.compile(r"[_/=+-]+")
_PART = re.compile(r"([a-z]*|[A-Z]*|[A-Z][a-z]*)[0-9]*")
_NUMBER = re.compile(r"[0-9]+")

_vocabularies: dict[str, tiktoken.Encoding] = {}


def vocabulary(path: str | None = None) -> tiktoken.Encoding:
    """This worker's tiktoken vocabulary from a file of ranks."""
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    if path not in _vocabularies:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _vocabularies[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def is_name(run: str) -> bool:
    """Whether a run is a number, or parts of one case between separators; linear in its length."""
    parts = _BETWEEN.split(run)
    return bool(_NUMBER.fullmatch(run)) or (len(parts) > 1 and all(_PART.fullmatch(p) for p in parts))


def excluded(run: str, digests: frozenset[str] = frozenset(), before: str = "") -> bool:
    """Whether a run is a known digest, by itself or by the text before it, or an identifier."""
    if len(run) in _DIGEST_SIZES and _DIGEST.fullmatch(run) and (run.lower() in _EMPTY_DIGESTS or _NAMED.search(before)):
        return True
    return run.lower() in digests or bool(_UUID.fullmatch(run)) or is_name(run)


def _stretches(run: str, before: str, digests: frozenset[str]) -> Iterator[tuple[int, int]]:
    """What is left of a run between its UUIDs and the parts that are known digests."""
    at = 0
    known = [m.span() for m in _UUID_INSIDE.finditer(run)]
    for m in _SOLID.finditer(run):
        part = m[0]
        if part.lower() in digests or (len(part) in _DIGEST_SIZES and excluded(part, digests, (before + run[: m.start()])[-_BEFORE:])):
            known.append(m.span())
    for start, end in sorted(known):
        if start >= at:
            yield at, start
            at = end
    yield at, len(run)


def random_parts(run: str, tool: tiktoken.Encoding, digests: frozenset[str] = frozenset(), before: str = "") -> list[tuple[int, int]]:
    """Places of the random strings in a run; ``before`` is the text in front of it."""

    def noise(piece: str) -> bool:
        return not is_name(piece) and len(piece) <= MAX_RATIO * len(tool.encode_ordinary(piece))

    if excluded(run, digests, before):
        return []
    stretches = list(_stretches(run, before, digests))
    if len(run) >= MIN_RUN and stretches == [(0, len(run))] and noise(run):
        return [(0, len(run))]
    parts = [m.span() for m in _SOLID.finditer(run)]
    out: list[list[int]] = []
    for low, high in stretches:
        # Parts by themselves, then windows of a few sizes at every place.
        hits = [(a, b) for a, b in parts if low <= a and b <= high and b - a >= LEAST_PART and noise(run[a:b])]
        for size in range(LEAST_PART, MIN_RUN + 5, 4):
            hits += [(a, a + size) for a in range(low, high - size + 1) if noise(run[a : a + size])]
        for start, end in _met(hits):
            inside = [(max(a, low), min(b, high)) for a, b in parts if a < end and b > start]
            # Words at the ends, of which a window took a piece, do not belong to it.
            while len(inside) > 1 and _is_word(run[slice(*inside[0])], tool):
                inside.pop(0)
            while len(inside) > 1 and _is_word(run[slice(*inside[-1])], tool):
                inside.pop()
            out.append([inside[0][0], inside[-1][1]])
    return _met(out)


def _is_word(part: str, tool: tiktoken.Encoding) -> bool:
    return len(part) >= 4 and bool(_PART.fullmatch(part)) and len(part) > MAX_RATIO * len(tool.encode_ordinary(part))


def _met(spans) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def spans_of(text: str, tool: tiktoken.Encoding, digests: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all spans, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _RUN.finditer(text):
        before = text[max(0, m.start() - _BEFORE) : m.start()]
        found += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(m[0], tool, digests, before)]
    return sorted(found)


def possible(texts: pa.Array) -> list[bool]:
    """Whether a text may have any span."""
    hits = pc.match_substring_regex(texts, _SIEVES[0])
    for sieve in _SIEVES[1:]:
        hits = pc.or_(hits, pc.match_substring_regex(texts, sieve))
    return pc.fill_null(hits, False).to_pylist()


def each_text(texts: pa.Array, path: str | None, digests: frozenset[str]) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """Number, text and spans of the texts that have any."""
    tool = vocabulary(path)
    for i, maybe in enumerate(possible(texts)):
        if maybe:
            text = texts[i].as_py()
            if spans := spans_of(text, tool, digests):
                yield i, text, spans


def scan(
    docs: DataFrame, text: str = "text", path: str | None = None, digests: frozenset[str] = frozenset(), keep: list[str] | None = None
) -> DataFrame:
    """The columns kept and ``secret_spans``, an array of ``kind, start, end`` by start and kind."""

    def make(texts: pa.Array) -> dict[str, pa.Array]:
        rows: list[list[dict]] = [[] for _ in range(len(texts))]
        for i, _, spans in each_text(texts, path, digests):
            rows[i] = [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in spans]
        return {"secret_spans": pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))}

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return add_columns(docs, text, make, T.StructType([T.StructField("secret_spans", T.ArrayType(span))]), keep)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", path: str | None = None, digests: frozenset[str] = frozenset(), size: str | None = None) -> DataFrame:
    """The same rows and columns with the secrets of the texts replaced; ``size`` is a column of text lengths to renew."""

    def make(texts: pa.Array) -> dict[str, pa.Array]:
        now = texts.to_pylist()
        for i, content, spans in each_text(texts, path, digests):
            now[i] = redacted(content, spans)
        return {"_clean": pa.array(now, pa.string())}

    names = [f"_doc{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    renamed = docs.toDF(*names)
    clean = add_columns(renamed, names[at], make, T.StructType([T.StructField("_clean", T.StringType())]), [n for i, n in enumerate(names) if i != at])
    out = {n: F.col(n) for n in names} | {names[at]: F.col("_clean")}
    if size is not None:
        i = docs.columns.index(size)
        out[names[i]] = F.length("_clean").cast(docs.schema[size].dataType)
    return clean.select(*[out[n].alias(c) for n, c in zip(names, docs.columns)])


def _joined(kinds: tuple[str, ...]):
    chosen = F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[_count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"),
        _count("random").alias("n_random"),
    )
