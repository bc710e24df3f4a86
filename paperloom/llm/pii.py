"""Personal data: base patterns, and more spans by weak supervision.

Four kinds follow fixed patterns (email, ip, card, phone) and are final. The method adds spans of other kinds. Candidate
spans are long digit groups, hexadecimal or mixed keys and capitalised pairs; labelers vote on each (personal, not, or
silent):

* regex labelers look at the candidate's own form and at the variety of its characters,
* the gazetteer labeler looks names up in a list of given names, and keys in a list of words that fill a blank,
* context labelers look at the words before it, among them names of secrets and of numbers, at what assigns it, and at
  where its sentence begins.

How often each pattern of votes occurs is counted over all documents; there are at most ``3 ** labelers`` patterns, so
these counts fit the driver. Expectation-maximisation estimates from them each labeler's reliability and the posterior
of every pattern. A logistic span classifier is then trained on the posteriors of a bounded sample of candidates that
somebody voted on, and decides on all. It doesn't see votes: its features are shape, length, and the hashed words on
both sides, so it also takes candidates that no labeler knows. Where nobody votes on any candidate, none is taken.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in order.
ADDED = ("secret", "number", "name")
#: The most candidates that the span classifier is trained on.
TRAIN_SPANS = 20_000

# Fixed patterns. Possessive runs and look-behinds find the same leftmost matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the whole run before an @ that earlier matches leave, so runs are not tried from every start."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        after = at + 1
        if m:
            found.append((start, m.end()))
            after = m.end()
        at = text.find("@", after)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four fixed kinds: by kind, then start; code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-3].strip("0") for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


#: Candidates of the added kinds, tried in this order at each place.
_CANDIDATE = re.compile(
    r"""(?P<secret>(?<![A-Za-z0-9+/=_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_+/-]{20,}+=*)"""
    r"""|(?P<number>(?<![A-Za-z0-9.+-])[0-9]{1,4}(?:[ -]?[0-9]){7,17}(?![A-Za-z0-9]))"""
    r"""|(?P<name>(?<![A-Za-z])(?:[A-Z][a-z]{1,20}+ ){1,2}[A-Z][a-z]{1,20}+(?![A-Za-z]))"""
)
#: Gazetteers: given names, and words of keys that stand for one to be filled in (fixed values).
GIVEN = frozenset("""
james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica
thomas sarah charles karen christopher nancy daniel lisa matthew margaret anthony sandra mark ashley donald kimberly
steven emily paul donna andrew michelle joshua carol kenneth amanda kevin melissa brian deborah george stephanie
maria anna jean marie pierre hans peter jose carlos ana luis juan miguel antonio manuel francisco javier carmen isabel
lucia elena sofia pablo diego jacques francois nicolas camille claire sophie julie louis henri philippe klaus jurgen
wolfgang heike sabine monika ursula stefan andreas markus katrin birgit giulia marco luca paolo francesca
""".split())
FILLERS = frozenset("example changeme placeholder sample dummy lorem test your xxxx abcdef".split())
#: Context: words that head a secret, number or name (fixed values).
SECRET_WORDS = frozenset("token secret key password passwd pwd api apikey bearer credential auth".split())
NUMBER_WORDS = frozenset("ssn passport account acct iban licence license id tax phone tel mobile card member policy".split())
NAME_WORDS = frozenset("mr mrs ms dr name contact dear signed by".split())
#: And words that head plain numbers, and titles that are part of a name.
PLAIN_WORDS = frozenset("order invoice item page part version issue ticket chapter figure table serial sku lot build".split())
TITLES = frozenset("mr mrs ms dr prof sir".split())
#: Heads of keys that services give out (fixed values).
_ISSUED = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ)")
_WORD = re.compile(r"[A-Za-z]+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SENTENCE = re.compile(r"(?:^|[.!?\n])\s*$")

LABELERS = ("form", "variety", "gazetteer", "word_before", "assigned", "sentence_start")
#: Numbers of a candidate's own, and hash buckets of each of its neighbours (two words before, one after).
SHAPES, NEIGHBOURS = 9, 64


def _entropy(s: str) -> float:
    n = np.bincount(np.frombuffer(s.encode("utf-8", "ignore"), np.uint8))
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """1 personal, 0 not, 2 silent, for each labeler."""
    s = text[start:end]
    near = [w.lower() for w in _WORD.findall(text[max(0, start - 32) : start])[-2:]]
    lead = text[max(0, start - 4) : start]
    plain = s.replace("-", "").replace(" ", "")
    form = variety = listed = first = 2
    if kind == "secret":
        form = 1 if _ISSUED.match(s) or _HEX.fullmatch(s) and len(s) in (32, 40, 64) else 2
        entropy, digits = _entropy(s), sum(c.isdigit() for c in s)
        variety = 0 if entropy < 2.5 else 1 if entropy > 3.2 and digits >= 3 else 2
        low = s.lower()
        listed = 0 if any(w in low for w in FILLERS) else 2
    elif kind == "number":
        # as long as a card's but not one
        form = 1 if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s) else 0 if len(plain) >= 13 and not luhn(plain) else 2
        variety = 0 if len(set(plain)) <= 2 else 2
    else:
        parts = s.lower().split()
        variety = 0 if len(set(parts)) < len(parts) else 2
        listed = 1 if any(w in GIVEN for w in parts[:-1] if w not in TITLES) else 0
        first = 0 if _SENTENCE.search(text[max(0, start - 4) : start]) else 2
    wanted = {"secret": SECRET_WORDS, "number": NUMBER_WORDS, "name": NAME_WORDS}[kind]
    context = 1 if any(w in wanted for w in near) or kind == "name" and parts[0] in TITLES else 0 if kind == "number" and any(w in PLAIN_WORDS for w in near) else 2
    assigned = 1 if any(c in lead for c in "=:\"'") else 0 if kind == "secret" else 2
    return [form, variety, listed, context, assigned, first]


def features(kind: str, text: str, start: int, end: int) -> tuple[list[float], list[int]]:
    """What the span classifier sees: numbers of the candidate's shape, and the buckets of its neighbours."""
    s = text[start:end]
    n = len(s)
    shape = [1.0 * (kind == "secret"), 1.0 * (kind == "number"), 1.0 * (kind == "name"), min(n, 64) / 64, sum(c.isdigit() for c in s) / n]
    shape += [sum(c.isupper() for c in s) / n, len(set(s)) / min(n, 64), min(s.count(" ") + s.count("-"), 8) / 8, 1.0 * (not text[end : end + 1].isspace())]
    before = ["", "", *(w.lower() for w in _WORD.findall(text[max(0, start - 32) : start])[-2:])][-2:]
    after = _WORD.match(text[end : end + 24].lstrip(" \"',.;:)"))
    words = [*before, after.group().lower() if after else ""]
    return shape, [i * NEIGHBOURS + zlib.crc32(w.encode()) % NEIGHBOURS for i, w in enumerate(words)]


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Candidate spans of the added kinds that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    i = 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            yield m.lastgroup, a, b


def _candidate(text: str, kind: str, start: int, end: int) -> dict:
    code = 0
    for x in votes(kind, text, start, end):
        code = 3 * code + x
    shape, near = features(kind, text, start, end)
    return {"kind": kind, "start": start, "end": end, "votes": code, "shape": shape, "near": near}


FOUND = "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, cands array<struct<kind:string,start:int,end:int,votes:int,shape:array<float>,near:array<int>>>"


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and candidates with their votes (base 3, first labeler first) of every text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("shape", pa.list_(pa.float32())), ("near", pa.list_(pa.int32()))])
    for batch in batches:
        base, counts, cands = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
            counts.append([sum(k == kind for k, _, _ in spans) for kind in KINDS])
            rows = [_candidate(text, *c) for c in candidates(text, spans)]
            cands.append(rows)
        per_kind = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), *per_kind, pa.array(cands, pa.list_(span))], [x.split()[0] for x in FOUND.split(", ", 6)])


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns with counts.

    Returns per pattern the posterior of "personal", per labeler the chance that a vote on a personal span says so, and
    that a vote on another says not. Silent votes tell nothing. Starts from labelers that are right four times in five.
    """
    k = len(LABELERS)
    v = np.array([[c // 3 ** (k - 1 - i) % 3 for i in range(k)] for c in codes]).reshape(-1, k)
    cast, yes = v < 2, v == 1
    right, prior = np.full((2, k), 0.8), 0.5
    post = np.full(len(codes), 0.5)
    for _ in range(rounds):
        pos = np.where(yes, np.log(right[1]), np.log(1 - right[1])) * cast
        neg = np.where(yes, np.log(1 - right[0]), np.log(right[0])) * cast
        z = pos.sum(axis=1) - neg.sum(axis=1) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        w1, w0 = counts * post, counts * (1 - post)
        # a few imagined votes keep chances away from 0 and 1, and labelers better than a coin
        right[1] = np.clip(((w1[:, None] * cast * yes).sum(axis=0) + 8) / ((w1[:, None] * cast).sum(axis=0) + 10), 0.55, 0.99)
        right[0] = np.clip(((w0[:, None] * cast * ~yes).sum(axis=0) + 8) / ((w0[:, None] * cast).sum(axis=0) + 10), 0.55, 0.99)
        prior = float(np.clip((w1.sum() + 1) / (counts.sum() + 2), 0.05, 0.95))
    return post, right[1], right[0]


def _logits(shape: np.ndarray, near: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return shape @ weights[:SHAPES] + weights[SHAPES:-1][near].sum(axis=1) + weights[-1]


def train_spans(shape: np.ndarray, near: np.ndarray, target: np.ndarray, rounds: int = 300, step: float = 2.0) -> np.ndarray:
    """Weights (shape, neighbours, the constant) of a logistic model of soft targets; without rows, one that takes nothing."""
    w = np.zeros(SHAPES + 3 * NEIGHBOURS + 1)
    if not len(target):
        w[-1] = -1.0
        return w
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-np.clip(_logits(shape, near, w), -50, 50))) - target) / len(target)
        back = np.bincount(near.ravel(), weights=np.repeat(gap, near.shape[1]), minlength=3 * NEIGHBOURS)
        w -= step * (np.concatenate([shape.T @ gap, back, [gap.sum()]]) + 1e-4 * w)
    return w


def added(cands: list[dict], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Those candidates that the span classifier takes: by kind, then start."""
    if not cands:
        return []
    keep = _logits(np.array([c["shape"] for c in cands]), np.array([c["near"] for c in cands]), weights) > 0
    found = sorted((ADDED.index(c["kind"]), c["start"], c["end"]) for c, k in zip(cands, keep, strict=True) if k)
    return [(ADDED[k], a, b) for k, a, b in found]


def _found(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, FOUND), "spans")


def personal_data(docs: DataFrame, train: int = TRAIN_SPANS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row of ``docs`` (doc_id, text).

    Spans are ``kind:start:end`` in code points, end exclusive, by kind (base kinds first), then start. A null text is
    empty and has none. Repeated rows get equal results, a null doc_id stays null. Other columns are not used. An empty
    table gives an empty result. Texts are read once and whole, however long; counts of votes cover all of them. Where
    no labeler votes on any candidate, nothing is added to the base spans.
    """
    found = _found(docs)
    weights = fit(found, train)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, spans = [], []
            for base, cands in zip(batch.column(1).to_pylist(), batch.column(6).to_pylist(), strict=True):
                sha.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join([*([base] if base else []), *(f"{k}:{a}:{b}" for k, a, b in added(cands, weights))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:6], pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def fit(found: DataFrame, train: int) -> np.ndarray:
    """The span classifier's weights, from the votes on all candidates and a sample of ``train`` of them."""
    cands = found.select("doc_id", F.explode("cands").alias("c")).select("doc_id", "c.*")
    patterns = sorted((r.votes, r.n) for r in cands.groupBy("votes").agg(F.count("*").alias("n")).collect())  # 3 ** labelers rows at most
    codes, counts = np.array([c for c, _ in patterns], int), np.array([n for _, n in patterns], float)
    silent = int("2" * len(LABELERS), 3)
    post, *_ = reliabilities(codes, counts)
    by_code = dict(zip(codes.tolist(), post.tolist(), strict=True))
    sample = cands.where(F.col("votes") != silent).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(train).select("votes", "shape", "near").toArrow()
    shape, near = (np.array(sample.column(c).to_pylist(), kind).reshape(-1, k) for c, kind, k in (("shape", float, SHAPES), ("near", int, 3)))
    return train_spans(shape, near, np.array([by_code[c] for c in sample.column("votes").to_pylist()]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; of spans that overlap, the first stays."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, train: int = TRAIN_SPANS) -> DataFrame:
    """``docs`` with all personal data in ``text`` replaced by its kind in brackets; rows and columns stay as they are.

    The spans are those of ``personal_data``. A null text stays null; an empty table gives an empty result. Texts are
    read twice and whole, however long.
    """
    weights = fit(_found(docs), train)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(place).to_pylist():
                if text:
                    base = base_spans(text)
                    more = added([_candidate(text, *c) for c in candidates(text, base)], weights)
                    text = masked(text, base + more) if base or more else text
                texts.append(text)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
