"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Fixed patterns (assignments, access keys, long hex) always count.  The battery looks at every other
token ``[A-Za-z0-9+/_=-]{16,}``: its encoding is inferred (the smallest of hex, base26, base32, base36,
base62 and base64 that holds its characters), and four tests ask whether its symbols look drawn at
random from that alphabet: chi-squared of the symbol counts over equal parts of the alphabet, runs above
and below the middle, lag-one serial correlation, and the likelihood of its symbol pairs in prose (one-sided,
against its mean and variance for random symbols).  Fisher's method joins the four p-values to one score.

What prose scores by chance depends on a token's length and alphabet, so the score becomes a p-value
against a reference for each length class and encoding.  The reference covers the words of all documents
(those outside the tokens under test): each distinct text's words are cut into blocks, every block is written as
names and paths are (``STYLES``) in one encoding, and its windows are scored in the length classes, both dealt
by the text's hash; Spark adds up the pair counts and the histograms of scores.  ``BUILT_IN`` prose always counts
besides, so that no class is without a reference, whatever the script or the number of the documents.  Beyond the
last ``TAIL`` members, p falls off exponentially in the root of the log score, fitted to those members: p has no floor.

Within each length class and encoding, Benjamini-Hochberg at ``FDR`` over the distinct tokens of all documents
then sets the cut; the driver holds at most ``BINS`` counts for each, not the tokens.

Cases: null text is empty; repeated rows are scanned one by one; very long texts are scanned whole, in
linear time; tokens of equal score share their verdict, and spans that begin together are listed by kind; an empty
table gives no rows; other columns stay unless they have the name of an added one.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import map_text, materialise

KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
BLOCK_WORDS = 64
BUILT_IN_WINDOWS = 500  # about so many members of each class come from the built-in prose
TAIL = 100  # at least so many members (and half a percent) are fitted
BINS, BIN = 1000, 0.02  # of the root of minus the log score
LENGTHS = (16, 20, 24, 32, 40, 64, 128)  # lower ends of the length classes

ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Alphabets in order of size; a token's encoding is the first that holds all its characters.
ALPHABETS = {
    "hex": "0123456789abcdef", "hex_upper": "0123456789ABCDEF", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base36_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
NAMES = tuple(ALPHABETS)
SIZES = np.array([len(ALPHABETS[n]) for n in NAMES])
_HOLDS = np.zeros((len(NAMES), 128), bool)
_INDEX = np.zeros((len(NAMES), 128), np.int64)
#: Symbols stand in the order of their frequency in prose (small letters, then capitals, digits, others), so
#: that equal parts of an alphabet, and its two halves, are what prose fills most unevenly.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def _prose_rank(c: str) -> tuple[int, int]:
    if c.lower() in FREQUENT:
        return int(c.isupper()), FREQUENT.index(c.lower())
    return 2 if c.isdigit() else 3, ord(c)


for _k, _n in enumerate(NAMES):
    for _i, _c in enumerate(sorted(ALPHABETS[_n], key=_prose_rank) if not _n.startswith("hex") else ALPHABETS[_n]):
        _HOLDS[_k, ord(_c)], _INDEX[_k, ord(_c)] = True, _i


def base_spans(text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed.  ``tokens`` are the
    spans of TOKEN, which hold every access key and long hex run."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    for a, b in tokens:
        part = text[a:b]
        if "AKIA" in part:
            found += [("access", a + m.start(), a + m.end()) for m in ACCESS.finditer(part) if len(m[0]) >= 16]
        if b - a >= 32:
            found += [("hex", a + m.start(), a + m.end()) for m in HEX.finditer(part)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def spelled(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _chi2_tail(x: np.ndarray, half: np.ndarray) -> np.ndarray:
    """P(chi-squared with 2 * half degrees of freedom > x)."""
    term, total = np.ones_like(x), np.zeros_like(x)
    for j in range(int(half.max(initial=1))):
        total = np.where(j < half, total + term, total)
        term = term * (x / 2) / (j + 1)
    return np.exp(-x / 2) * total


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a standard normal (to 1e-7)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.clip(poly * np.exp(-x * x), 1e-300, 1)


def infer(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The index of each token's encoding (padding ``=`` aside)."""
    begins = np.cumsum(lengths) - lengths
    out = np.full(len(starts), len(NAMES) - 1)
    for k in range(len(NAMES) - 1, -1, -1):
        ok = _HOLDS[k][chars] | (chars == ord("="))
        out = np.where(np.logical_and.reduceat(ok, begins), k, out)
    return out


class Pairs:
    """How likely symbol pairs are in prose, by encoding: the log of a symbol's probability behind another one,
    less its mean, and the variance of that for random symbols."""

    def __init__(self, counts: np.ndarray):
        self.excess, self.variance = np.zeros((len(NAMES), 128, 128)), np.ones(len(NAMES))
        for k, name in enumerate(NAMES):
            at = np.array([ord(c) for c in ALPHABETS[name]])
            n = counts.reshape(len(NAMES), 128, 128)[k][np.ix_(at, at)].astype(float)
            single = (n.sum(axis=0) + 1) / (n.sum() + len(at))
            log = np.log((n + 10 * single) / (n.sum(axis=1, keepdims=True) + 10))
            log -= log.mean()
            self.excess[k][np.ix_(at, at)] = log
            self.variance[k] = max(1e-9, (log * log).mean() + 2 * (log.mean(axis=0) * log.mean(axis=1)).mean())
        self.excess = self.excess.reshape(-1).astype(np.float32)


def pair_codes(chars: np.ndarray, lengths: np.ndarray, encoding: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in ``Pairs`` of each symbol behind its token's first one, and where these symbols are."""
    inner = np.ones(len(chars), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    return np.repeat(encoding, lengths)[at] * 16384 + chars[at - 1] * 128 + chars[at], at


def battery(chars: np.ndarray, lengths: np.ndarray, encoding: np.ndarray, pairs: Pairs) -> np.ndarray:
    """The score of each token (tokens one after another in ``chars``): Fisher's joint p-value of the
    four tests, near 0 for tokens that do not look random in their encoding."""
    n = len(lengths)
    if not n:
        return np.zeros(0)
    token = np.repeat(np.arange(n), lengths)
    begins = np.cumsum(lengths) - lengths
    size = SIZES[encoding]
    symbol = _INDEX[encoding[token], chars]
    parts = np.select([lengths < 24, lengths < 40, lengths < 80], [3, 5, 7], 9)
    part = symbol * parts[token] // size[token]
    counts = np.bincount(token * 9 + part, minlength=9 * n).reshape(n, 9)
    # symbols that fall into each part, as the parts need not divide the alphabet
    edges = -(-np.arange(10)[None, :] * size[:, None] // parts[:, None])
    expect = np.where(np.arange(9)[None, :] < parts[:, None], np.diff(edges, axis=1) / size[:, None], 0) * lengths[:, None]
    chi = np.where(expect > 0, (counts - expect) ** 2 / np.where(expect > 0, expect, 1), 0).sum(axis=1)
    p_chi = _chi2_tail(chi, (parts - 1) // 2)

    up = 2 * symbol + 1 > size[token]
    n1 = np.add.reduceat(up.astype(float), begins)
    n2 = lengths - n1
    change = np.zeros(len(chars))
    change[1:] = up[1:] != up[:-1]
    change[begins] = 0
    runs = 1 + np.add.reduceat(change, begins)
    mean = 1 + 2 * n1 * n2 / lengths
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(lengths - 1, 1), 1e-9)
    p_runs = np.where(n1 * n2 > 0, _normal_tail((runs - mean) / np.sqrt(var)), 1e-12)

    x = symbol - np.add.reduceat(symbol.astype(float), begins)[token] / lengths[token]
    follow = np.zeros(len(chars))
    follow[1:] = x[1:] * x[:-1]
    follow[begins] = 0
    power = np.add.reduceat(x * x, begins)
    r = np.add.reduceat(follow, begins) / np.maximum(power, 1e-9)
    p_serial = np.where(power > 0, _normal_tail((r + 1 / lengths) * np.sqrt(lengths)), 1e-12)

    codes, at = pair_codes(chars, lengths, encoding)
    excess = np.zeros(len(chars))
    excess[at] = pairs.excess[codes]
    z = np.add.reduceat(excess, begins) / np.sqrt(np.maximum(lengths - 1, 1) * pairs.variance[encoding])
    p_pairs = np.maximum(np.where(z > 0, _normal_tail(z) / 2, 1 - _normal_tail(z) / 2), 1e-300)
    fisher = -2 * (np.log(np.maximum(p_chi, 1e-300)) + np.log(p_runs) + np.log(p_serial) + np.log(p_pairs))
    return _chi2_tail(fisher, np.full(n, 4))


def length_class(lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, lengths, "right") - 1


def score_codes(chars: np.ndarray, lengths: np.ndarray, encoding: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Encoding, length class and score bin of each token in one number; low bins look random."""
    root = np.sqrt(-np.log(np.clip(battery(chars, lengths, encoding, pairs), 1e-300, 1)))
    return (encoding * len(LENGTHS) + length_class(lengths)) * BINS + np.minimum((root / BIN).astype(np.int64), BINS - 1)


#: The ways that names and paths are written: words run together, in camel case, with numbers, joined by a character.
STYLES = {n: ["plain"] if n.startswith("hex") or n in ("lower", "upper") else ["plain", "numbered"] + (["camel", "camel_numbered"] if "a" in a and "A" in a else []) + [c for c in "/-_" if c in a] for n, a in ALPHABETS.items()}
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_SPLIT = str.maketrans("+/_=-", "     ")
#: Hex: the letters' places, wrapped to the sixteen symbols.
_WRAPPED = {n: str.maketrans({c: ALPHABETS[n][(ord(c) - 97) % 16] for c in ALPHABETS["lower"]}) for n in ("hex", "hex_upper")}
_NO_DIGITS, _NO_BASE32 = (str.maketrans("", "", x) for x in ("0123456789", "0189"))
BUILT_IN = """the of and to in is that it was for on are with as his they be at one have this from or had by but some what there we can out other were all your
when use word how said each she which do their time will way about many then them would write like so these long make thing see him two has look more day could go
come did number sound no most people my over know water than call first who may down side been now find any new work part take get place made live where after back
little only round man year came show every good me give our under name very through just form sentence great think say help low line differ turn cause much mean before
data file path user index value config server client module service request response manager handler factory controller report test build source target default system""".split()


def written(words: list[str], encoding: int, style: str) -> str:
    """Words in one encoding and style, as far as the alphabet allows."""
    name = NAMES[encoding]
    alphabet = ALPHABETS[name]
    if name in _WRAPPED:
        return "".join(words).lower().translate(_WRAPPED[name])
    if "numbered" in style:
        words = [f"{w}{(7919 * k) % 100}" if k % 3 == 0 else w for k, w in enumerate(words)]
    if "camel" in style:
        return "".join([w.capitalize() if w.islower() else w for w in words])
    text = (style if style in "/-_" else "").join(words)
    text = text if "a" in alphabet and "A" in alphabet else text.lower() if "a" in alphabet else text.upper()
    return text if "9" in alphabet else text.translate(_NO_DIGITS if "2" not in alphabet else _NO_BASE32)


def windows(words: list[str], seed: int) -> list[tuple[bytes, int]]:
    """Reference members (with their encoding) from a text's words: every block of words is written in one encoding
    and style and cut into windows of the length classes, in turn; the last one ends where the block ends."""
    out = []
    for at in range(0, len(words), BLOCK_WORDS):
        deal = seed + 2_654_435_761 * (at // BLOCK_WORDS)
        k, deal = deal % len(NAMES), deal // len(NAMES)
        styles = STYLES[NAMES[k]]
        text = written(words[at:at + BLOCK_WORDS], k, styles[deal % len(styles)]).encode()
        turn, start = deal // len(styles), 0
        while len(text) - start >= LENGTHS[0]:
            size = LENGTHS[turn % len(LENGTHS)]
            size = size if start + size <= len(text) else max(n for n in LENGTHS if n <= len(text) - start)
            out.append((text[start:start + size], k))
            start, turn = start + size, turn + 1
        if start < len(text) and len(text) >= LENGTHS[0]:
            out.append((text[-LENGTHS[0]:], k))
    return out


def plain_words(text: str) -> list[str]:
    """The words of a text outside the tokens under test."""
    return " ".join([w for w in RUN.findall(text) if len(w) < 16]).translate(_SPLIT).split()


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8).astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts))


@lru_cache(1)
def built_in() -> list[tuple[bytes, int]]:
    """Members from the built-in prose."""
    words = np.random.default_rng(0).choice(BUILT_IN, BLOCK_WORDS * len(NAMES) * BUILT_IN_WINDOWS)
    return windows(words.tolist(), 0)


def pairs_of(members: list[tuple[bytes, int]]) -> np.ndarray:
    """The place in ``Pairs`` of every symbol pair of the members."""
    chars, lengths = _joined([m for m, _ in members])
    return pair_codes(chars, lengths, np.array([k for _, k in members], np.int64))[0] if members else np.zeros(0, np.int64)


def learn_pairs(docs: DataFrame, text_col: str = "text") -> Pairs:
    """From the words of all documents, and the built-in prose."""
    def count(texts: list[str], _) -> dict[str, list]:
        codes, n = np.unique(pairs_of([m for t in texts for m in windows(plain_words(t), zlib.crc32(t.encode("utf-8", "replace")))]), return_counts=True)
        return {"pairs": [[{"code": a, "n": b} for a, b in zip(codes.tolist(), n.tolist())], *[[]] * (len(texts) - 1)]}

    schema = T.StructType([T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])))])
    rows = map_text(docs, count, schema, text_col, ()).select(F.explode("pairs").alias("p")).groupBy("p.code").agg(F.sum("p.n").alias("n")).collect()
    counts = np.bincount(pairs_of(built_in()), minlength=len(NAMES) * 16384)
    for r in rows:
        counts[r["code"]] += r["n"]
    return Pairs(counts)


def p_values(members: np.ndarray) -> np.ndarray:
    """For each bin the part of the reference that scores as high, from a histogram with at least one member.  Where
    fewer than the fitted members score as high, the exponential tail through them."""
    total = members.sum()
    upto = np.cumsum(members)
    p = (upto + 1) / (total + 1)
    edge = int(np.searchsorted(upto, min(total, max(TAIL, total // 200))))  # the fitted members: bins up to here
    own = members[:edge + 1]
    spread = max(BIN, (own * (edge + 0.5 - np.arange(edge + 1))).sum() / own.sum() * BIN)
    p[:edge] = p[edge] * np.exp(-(edge - np.arange(edge)) * BIN / spread)
    return np.minimum(p, 1)


_SCANNED = T.StructType([T.StructField("base", T.StringType()), T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("encoding", T.StringType()), T.StructField("code", T.IntegerType()), T.StructField("id", T.LongType())]))),
                        T.StructField("text_id", T.BinaryType()), T.StructField("members", T.ArrayType(T.IntegerType()))])


def _hash(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def scan(texts: list[str], pairs: Pairs) -> dict[str, list]:
    """Base spans, scored tokens (those that no base span touches) and scored reference members of each text."""
    out: dict[str, list] = {f.name: [] for f in _SCANNED.fields}
    owners, spans, parts, members, sizes = [], [], [], [], []
    for k, text in enumerate(texts):
        tokens = [m.span() for m in TOKEN.finditer(text)]
        base = base_spans(text, tokens)
        out["base"].append(spelled(base))
        for kind in KINDS[:3]:
            out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
        for a, b in tokens:
            if not any(x < b and a < y for _, x, y in base):
                owners.append(k)
                spans.append((a, b))
                parts.append(text[a:b].encode())
        out["tokens"].append([])
        data = text.encode("utf-8", "replace")
        out["text_id"].append(_hash(data, 16))
        more = windows(plain_words(text), zlib.crc32(data))
        members += more
        sizes.append(len(more))
    if parts:
        chars, lengths = _joined(parts)
        encoding = infer(chars, np.cumsum(lengths) - lengths, lengths)
        for k, (a, b), part, e, x in zip(owners, spans, parts, encoding.tolist(), score_codes(chars, lengths, encoding, pairs).tolist()):
            out["tokens"][k].append({"start": a, "end": b, "encoding": NAMES[e], "code": x, "id": int.from_bytes(_hash(part), "big", signed=True)})
    codes = np.zeros(0, np.int32)
    if members:
        chars, lengths = _joined([m for m, _ in members])
        codes = score_codes(chars, lengths, np.array([k for _, k in members], np.int64), pairs).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32)
    out["members"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes))
    return out


def benjamini_hochberg(counts: list[tuple[int, float, int]], rate: float = FDR) -> dict[int, float]:
    """For each stratum, the largest p-value that the step-up rule accepts, from (stratum, p, tokens)."""
    cuts: dict[int, float] = {}
    for stratum in {s for s, _, _ in counts}:
        rows = sorted((p, n) for s, p, n in counts if s == stratum)
        m, seen = sum(n for _, n in rows), 0
        for p, n in rows:
            seen += n
            if p <= rate * seen / m:
                cuts[stratum] = p
    return cuts


def find_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with n_assign, n_access, n_hex, base_sha256,
    ``spans`` (all spans) and ``discoveries`` (the tokens that the battery found)."""
    pairs = learn_pairs(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(pairs)
    scanned = materialise(map_text(docs, lambda texts, _: scan(texts, held.value), _SCANNED, text_col, keep), "secret-scan")
    of_text = scanned.select("text_id", "members").where(F.size("members") > 0).groupBy("text_id").agg(F.first("members").alias("members"))  # copies count once
    seen = of_text.select(F.explode("members").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()
    chars, lengths = _joined([m for m, _ in built_in()])
    histogram = np.bincount(score_codes(chars, lengths, np.array([k for _, k in built_in()]), pairs), minlength=len(NAMES) * len(LENGTHS) * BINS)
    for r in seen:
        histogram[r["code"]] += r["n"]
    p = np.concatenate([p_values(h) for h in histogram.reshape(-1, BINS)])
    distinct = scanned.select(F.explode("tokens").alias("t")).select("t.code", "t.id").distinct().groupBy("code").agg(F.count("*").alias("n")).collect()
    cuts = benjamini_hochberg([(r["code"] // BINS, p[r["code"]], r["n"]) for r in distinct])
    accepted = {r["code"]: float(p[r["code"]]) for r in distinct if p[r["code"]] <= cuts.get(r["code"] // BINS, -1.0)}
    worst: dict[int, int] = {}
    for code in accepted:
        worst[code // BINS] = max(code, worst.get(code // BINS, 0))
    last = F.create_map(*[F.lit(x) for pair in worst.items() for x in pair]) if worst else F.create_map().cast("map<int,int>")
    p_of = F.from_json(F.lit(json.dumps(accepted)), "map<string,double>")
    found = F.transform(F.filter("tokens", lambda t: t["code"] <= F.coalesce(last[F.floor(t["code"] / BINS).cast("int")], F.lit(-1))),
                        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), p_of[t["code"].cast("string")].alias("p")))
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    every = F.concat(F.transform(base, lambda s: F.struct(F.split(s, ":")[1].cast("bigint").alias("start"), F.when(s.startswith("assign"), 0).when(s.startswith("access"), 1).otherwise(2).alias("kind"), s.alias("span"))),
                     F.transform("discoveries", lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), F.concat_ws(":", F.lit("random"), t["start"].cast("string"), t["end"].cast("string")).alias("span"))))
    spans = F.array_join(F.transform(F.array_sort(every), lambda s: s["span"]), ",")
    rows = scanned.withColumn("discoveries", found).withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256)).withColumn("spans", spans)
    return rows.drop("base", "tokens", "text_id", "members")
