"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) give spans that always stay. Wider patterns give candidates: all base spans, and
strings that might be an address spelt out, a secret, a card number that fails its check digit or a phone number in national
form, of any length. Labelers vote on each (1 for, -1 against, 0 abstains): the strict pattern, a gazetteer (top-level domains, given names, calling
codes, card issuers, prefixes of keys, blocks of private addresses), cue words before it, its surroundings, and its own make-up (check digits, variety of letters). A candidate is fully described by a signature
(kind, votes, shape), of which there are few, so counts by signature carry all that learning needs from all documents:
expectation-maximisation estimates how reliable each labeler is, and its posteriors train a logistic span classifier.
Candidates that it accepts, and that overlap no base span, are added; of accepted ones that overlap, the likelier stays, then
the earlier, then the longer, then the kind as listed.

Nulls are empty texts and have no spans. Repeated rows are each reported and each count in learning. With an empty table
or no candidates nothing is learned or added. Whole texts are read in linear time. Extra columns of any name pass through ``redact``.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from loomline.llm.common import bounded_batches, free, plain_names, slices, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LABELERS = ("pattern", "gazetteer", "cue", "context", "make_up")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)+", re.I)
_AT = re.compile(r"[\[(]at[\])]", re.I)
_NATIONAL = re.compile(r"(?<![0-9+.)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
#: The gazetteer.
DOMAINS = frozenset("com org net edu gov int io co info biz dev app de fr es it uk eu us nl ch at be pl pt se no dk fi cz ru cn jp in br ca au mx".split())
GIVEN_NAMES = frozenset("anna maria john james mary david peter paul laura sarah thomas michael robert jane jean marie pierre louis hans karl julia carlos jose juan luis ana pablo sofia emma lucas".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98", "351", "352", "353", "358", "420", "421")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "35", "36", "38", "6011", "65")
KEY_PREFIXES = ("sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghs_", "xox", "AKIA", "ASIA", "AIza", "glpat-", "eyJ")
PRIVATE_BLOCKS = ("0.", "10.", "127.", "169.254.", "192.168.", "255.")
_WORDS = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|address|adresse|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|from|client|address)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|account|karte|carte|tarjeta|iban)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|mobile|call|fax|telefon|téléphone|teléfono)\b", re.I),
    "secret": re.compile(r"\b(?:token|secret|key|password|passwd|pwd|api[_-]?key|bearer|auth)\b", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.domain, found from each @ outwards, so that long runs cost linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > free and (c := text[low - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            low -= 1
        end = _DOMAIN.match(text, at + 1) if low < at else None
        if end:
            out.append((low, end.end()))
            free = end.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """The base spans by start, then kind as listed, and the digit runs that fail the card rule by their check digit."""
    found, failed = [(a, b, "email") for a, b in emails(text)] if "@" in text else [], []
    for m in _IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19:
            if luhn(d):
                found.append((*m.span(), "card"))
            else:
                failed.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))), failed


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _listed(span: str, kind: str) -> int:
    """The gazetteer's vote."""
    if kind == "email":
        return 1 if re.split(r"[^a-z]+", low := span.lower())[-1] in DOMAINS or not GIVEN_NAMES.isdisjoint(re.split(r"[^a-z]+", low)) else 0
    if kind == "ip":
        return -1 if span.startswith(PRIVATE_BLOCKS) else 1
    if kind == "phone":
        return 1 if not span.startswith("+") or _digits(span).startswith(CALLING_CODES) else -1
    return 1 if span.startswith(ISSUERS if kind == "card" else KEY_PREFIXES) else 0


def _votes(text: str, a: int, b: int, kind: str, strict: bool) -> str:
    """The signature of a candidate: kind, votes of the labelers, length class, digit class."""
    span, before, after = text[a:b], text[max(0, a - 32) : a], text[b : b + 8]
    digits, letters = sum("0" <= c <= "9" for c in span), sum(c.isalpha() for c in span)
    words = 1 if _WORDS[kind].search(before) else 0
    tail = before.rstrip()[-1:]
    quoted = before[-1:] in "\"'`" and after[:1] in "\"'`" and before[-1:] != ""
    if kind == "secret":
        context = 1 if quoted or tail in ":=" and tail else -1
        make = 1 if digits >= 4 and letters >= 4 and len(set(span)) >= 10 else -1
    else:
        edge = (before[-1:] == "" or not before[-1:].isalnum()) and (after[:1] == "" or not after[:1].isalnum())
        context = 1 if edge and tail not in "=\"'#/" or edge and not tail else -1
        make = {
            "email": 1 if letters >= 3 else -1,
            "ip": 1 if not span.startswith("0") else -1,
            "card": 1 if luhn(_digits(span)) and len(set(_digits(span))) >= 3 else -1,
            "phone": 1 if 10 <= digits <= 15 and len(set(_digits(span))) >= 4 else -1,
        }[kind]
    return f"{kind}|{1 if strict else -1}|{_listed(span, kind)}|{words}|{context}|{make}|{min(len(span) // 8, 6)}|{4 * digits // max(1, len(span))}"


def candidates(text: str, base: list[tuple[int, int, str]], failed: list[tuple[int, int]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, kind, signature, is base) of the base spans and of what overlaps none of them."""
    out = [(a, b, k, _votes(text, a, b, k, True), True) for a, b, k in base]
    wide = [(a, b, "card") for a, b in failed]
    if _AT.search(text):
        wide += [(*m.span(), "email") for m in _SPELT.finditer(text)]
    wide += [(*m.span(), "phone") for m in _NATIONAL.finditer(text)]
    wide += [(*m.span(), "secret") for m in _SECRET.finditer(text) if any("0" <= c <= "9" for c in m[0])]
    taken, k, end = sorted((a, b) for a, b, _ in base), 0, 0  # end: how far the base spans that begin before reach
    for a, b, kind in sorted(wide):
        while k < len(taken) and taken[k][0] <= a:
            end, k = max(end, taken[k][1]), k + 1
        if end <= a and not (k < len(taken) and taken[k][0] < b):
            strict = kind == "secret" and bool(re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", text[a:b]))
            out.append((a, b, kind, _votes(text, a, b, kind, strict), False))
    return out


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType()), StructField("sig", StringType()), StructField("base", BooleanType())]))
_SPAN_ARROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("sig", pa.string()), ("base", pa.bool_())])


def _finder(text_col: str, kept: list[int], name: str):
    def find(batches):
        for batch in batches:
            for part, data in slices(batch, text_col):
                rows = []
                for raw in data:
                    text = raw.decode()
                    rows.append([dict(zip(("start", "end", "kind", "sig", "base"), c)) for c in candidates(text, *base_spans(text))])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(rows, pa.list_(_SPAN_ARROW))], names=[*(part.schema.names[i] for i in kept), name])

    return find


class SpanModel:
    """Labeler reliabilities by expectation-maximisation, and a logistic classifier trained on its posteriors."""

    def __init__(self, counts: dict[str, int], rounds: int = 50, steps: int = 400):
        self.signatures = sorted(counts)
        n = np.array([counts[s] for s in self.signatures], float)
        votes = np.array([[int(v) for v in s.split("|")[1:-2]] for s in self.signatures], int)
        p = np.clip(0.5 + votes.sum(axis=1) / (2.0 * votes.shape[1]), 0.05, 0.95)  # start: the majority
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            logit = np.full(len(n), np.log(prior / (1 - prior)))
            self.reliability = []
            for j in range(votes.shape[1]):
                yes, no = ((np.array([(n * w)[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + 1) for w in (p, 1 - p))
                yes, no = yes / yes.sum(), no / no.sum()
                self.reliability.append((yes, no))
                logit += np.log(yes / no)[votes[:, j] + 1]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        self.posterior = p
        x = self._features(self.signatures)
        w, weight = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
            step = np.linalg.solve(h, x.T @ (weight * (q - p)) + 1e-4 * w)
            w -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w
        self.probability = dict(zip(self.signatures, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))

    @staticmethod
    def _features(signatures: list[str]) -> np.ndarray:
        rows = []
        for s in signatures:
            kind, *votes, long, digits = s.split("|")
            rows.append([1.0, *(kind == k for k in KINDS), *map(float, votes), *(int(long) == i for i in range(7)), *(int(digits) == i for i in range(5))])
        return np.array(rows, float)


def resolved(spans: list[dict], probability: dict[str, float]) -> list[dict]:
    """Base spans and accepted candidates, by start, then kind as listed."""
    out = [s for s in spans if s["base"]]
    wide = [s for s in spans if not s["base"] and probability[s["sig"]] >= 0.5]
    taken: list[tuple[int, int]] = []
    for s in sorted(wide, key=lambda s: (-probability[s["sig"]], s["start"], -s["end"], KINDS.index(s["kind"]))):
        at = bisect.bisect(taken, (s["start"], s["end"]))
        if not (at and taken[at - 1][1] > s["start"]) and not (at < len(taken) and taken[at][0] < s["end"]):
            taken.insert(at, (s["start"], s["end"]))
            out.append(s)
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def candidate_table(docs: DataFrame, text_col: str, kept: list[str]) -> tuple[DataFrame, str]:
    """The columns of docs to keep and one of candidates, stored, and its name: texts are searched once."""
    bounded_batches(docs.sparkSession)
    name = free(docs, "spans")
    at = [docs.columns.index(c) for c in kept]
    schema = StructType([*(docs.schema.fields[i] for i in at), StructField(name, _SPANS)])
    return stored(docs.mapInArrow(_finder(text_col, at, name), schema), "spans"), name


def learn(found: DataFrame, name: str) -> dict[str, float]:
    """The probability of each signature that the candidates have, from all of them."""
    sigs = found.select(F.explode(F.col(name)["sig"]).alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    counts = {r["sig"]: r["n"] for r in sigs.collect()}  # bounded: kinds x votes x classes
    return SpanModel(counts).probability if counts else {}


def _reporter(name: str, probability: dict[str, float]):
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def settle(batches):
        for batch in batches:
            rows = [[{k: s[k] for k in ("start", "end", "kind", "base")} for s in resolved(r, probability)] for r in batch.column(name).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kinds)], names=["doc_id", "spans"])

    return settle


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, all spans as text, for each row of docs (doc_id, text)."""
    found, name = candidate_table(docs.select(F.col("doc_id").cast("long"), "text"), "text", ["doc_id"])
    rows = found.mapInArrow(_reporter(name, learn(found, name)), "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string,base:boolean>>")
    own = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(number, BASE), F.sha2(_written(own).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _redactor(text_at: int, probability: dict[str, float]):
    def redact(batches):
        for batch in batches:
            out = []
            for was, spans in zip(batch.column(text_at), batch.column(batch.num_columns - 1).to_pylist()):
                text, parts, last = was.as_py(), [], 0
                for s in resolved(spans or [], probability):
                    if s["start"] >= last:
                        parts += [text[last : s["start"]], f"<{s['kind'].upper()}>"]
                    last = max(last, s["end"])
                out.append("".join([*parts, text[last:]]) if parts else text)
            columns = [pa.array(out, pa.string()) if i == text_at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return redact


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets."""
    own, at = plain_names(docs), docs.columns.index(text_col)
    found, name = candidate_table(own, own.columns[at], own.columns)
    return found.mapInArrow(_redactor(at, learn(found, name)), own.schema).toDF(*docs.columns)
