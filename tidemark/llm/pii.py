"""Personal data by weak supervision.

Base rules find e-mail addresses, IP addresses, payment cards and telephone
numbers. Beyond them, loose patterns propose more spans: telephone numbers
without a plus sign, account numbers, social security numbers, dates of birth,
written-out addresses, credentials and names. Several labelers vote on every
proposal: validators of its form (regex), lists (gazetteer) and the words before
it (context). Expectation-maximisation over the vote patterns estimates, for
each kind, how often a labeler is right on true and on false spans and how many
spans are true. The probabilities it gives train the final classifier, a
logistic regression over votes and form, which decides which spans are added.

Votes and form make a pattern; there are few, whatever the corpus. Texts are
searched once: what was found in each is kept in the shared folder as a few
numbers, patterns are counted there, both models are fitted on these counts,
which cover all documents, and the classifier decides on what was kept.

Defined results: a null or empty text has no spans. Very long texts are searched
whole, in time that grows with text and spans. Equal rows give equal results.
Ids may be null. Other columns of any name stay as they are. An empty table
gives an empty result; without proposals the classifier adds nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, fresh_name, whole_text

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order after the base ones.
ADDED = ("secret", "iban", "ssn", "local_phone", "birth", "masked_email", "name")
KINDS = BASE + ADDED
THRESHOLD = 0.9
#: Weight of all proposals together in the classifier's training, whatever their
#: number; its ridge is 0.1.
TRAIN_WEIGHT = 1e6

# A match of the first pattern is what stands around each @: all that can come
# before it is taken, so only the part behind it is left to match.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs: a run of digits that fails at its start fails inside, too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def is_byte(number: str) -> bool:
    """Whether decimal digits, of any number, make at most 255."""
    rest = number.lstrip("0")
    return len(rest) < 3 or len(rest) == 3 and int(rest) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and place."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += (("email", a, b) for a, b in emails(text))
    if "." in text:
        out += (("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(is_byte, m[0].split("."))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += (("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15)
    return out


# Proposals: a pattern for each kind, whose group "v" is the span, and what a
# text must hold for it.
_PROPOSE = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])(?P<v>(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9_/+-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])(?P<v>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+.-])(?P<v>(?:\+[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9A-Za-z-])"),
    "birth": re.compile(r"(?<![0-9])(?P<v>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])"),
    "masked_email": re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Za-z0-9._-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4})", re.I),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20(?P<v>[A-ZÀ-Þ][a-zß-ÿ]{1,30}(?:\x20[A-ZÀ-Þ][a-zß-ÿ]{1,30}){0,2})"),
}
_DIGIT_KINDS = ("secret", "iban", "ssn", "local_phone", "birth")
_AT = re.compile(r"[\[(]\x20?at\x20?[\])]", re.I)
_WANTED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b")
#: Words whose presence before a span speaks for it, by kind.
CONTEXT = {
    "secret": ("token", "secret", "key", "password", "passwd", "apikey", "api_key", "credential", "bearer", "auth"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "cell"),
    "birth": ("born", "birth", "dob", "birthday", "geboren", "naissance", "nacimiento"),
    "masked_email": ("mail", "email", "e-mail", "contact", "write"),
    "name": ("name", "dear", "patient", "customer", "signed", "regards"),
}
#: Common given names of the four languages; country codes of account numbers and
#: the length that each has; usual ends of hosts. Parameters of the labelers.
GIVEN = frozenset(
    """
james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven emily paul donna andrew michelle joshua carol kenneth amanda kevin melissa brian deborah george stephanie timothy laura peter helen alice grace henry oliver emma sophie lucy jack harry charlotte
hans anna maria karl ursula klaus monika wolfgang petra juergen sabine stefan andrea uwe martina frank gabriele bernd heike dieter renate günter birgit jürgen heinz ingrid manfred helga gerhard elke markus claudia lukas lena felix hannah jonas
jean marie pierre claire michel nathalie alain isabelle philippe sylvie nicolas catherine christophe martine laurent christine françois sandrine julien camille antoine chloé louis manon jacques monique andré nicole rené hélène
jose carmen luis ana antonio isabel manuel pilar francisco dolores javier teresa carlos cristina miguel lucía jesús marta pedro elena rafael rosa alejandro josé juan pablo sergio laura fernando paula
""".split()
)
COUNTRIES = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29,
    ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20,
    LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25,
    QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
HOST_ENDS = frozenset("com net org edu gov io de fr es uk eu".split())


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def form_ok(kind: str, v: str) -> bool:
    """The regex labeler: whether the form is valid beyond the loose pattern."""
    if kind == "secret":
        return bool(re.fullmatch(r"[0-9a-fA-F]{32,128}", v)) or (any(c.isupper() for c in v) and any(c.islower() for c in v) and sum(c.isdigit() for c in v) >= 4)
    if kind == "iban":
        return iban_ok(v)
    if kind == "ssn":
        return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"
    if kind == "local_phone":
        return v[0] in "+(" or v[0] not in "01"
    if kind == "birth":
        p = [int(x) for x in re.split(r"[./-]", v)]
        y, m, d = p if p[0] > 31 else p[::-1]
        return 1900 <= y <= 2025 and 1 <= min(m, d) and min(m, d) <= 12 and max(m, d) <= 31
    return True


def listed(kind: str, v: str, before: str) -> int:
    """The gazetteer labeler: 1 for, 0 against, -1 abstains."""
    if kind == "iban":
        return int(COUNTRIES.get(v[:2]) == len(v.replace(" ", "")))
    if kind == "masked_email":
        return int(re.split(r"[^A-Za-z0-9]+", v.rstrip("])"))[-1].lower() in HOST_ENDS)
    if kind == "local_phone":
        return 1 if v[0] == "+" else -1
    if kind == "name":
        return int(v.split(" ")[0].lower() in GIVEN)
    if kind == "secret":  # code and markup hold long words, too
        return 0 if re.search(r"(?:https?://|www\.|[/=#.])$", before) and not re.search(r"[=:]\s?$", before) else -1
    return -1


def in_context(kind: str, before: str) -> int:
    found = re.findall(r"[\w-]+", before.lower())[-5:]
    return int(any(w in found for w in CONTEXT[kind]))


def quoted(v: str, before: str, after: str) -> int:
    """A second context labeler: a value that is assigned or set apart."""
    return int(v[0] in "+(" or bool(re.search(r"(?:[=:]\s?[\"'`]?|[\"'`(<])$", before)) or after[:1] in ("\"", "'", "`", ">"))


#: Values of a pattern: votes of form, list, context and setting (-1 abstains).
PATTERN_SIZE = 4


def merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover, in order, overlapping ones as one."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def proposals(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """Spans beyond the base ones, with their patterns; none overlaps another.
    What is taken is merged once for each kind and searched by halving."""
    starts, ends = merged((a, b) for _, a, b in taken)
    digit = any(map(text.__contains__, "0123456789"))
    for kind, rx in _PROPOSE.items():
        if (kind in _DIGIT_KINDS and not digit) or (kind == "masked_email" and not _AT.search(text)) or (kind == "name" and not _WANTED.search(text)):
            continue
        new = []
        for m in rx.finditer(text):
            a, b = m.span("v")
            if kind == "secret" and m["v"].isdigit():
                continue
            at = bisect_left(starts, b)  # what begins before b, the last of it
            if at and ends[at - 1] > a:
                continue
            before, after = text[max(0, a - 40) : a], text[b : b + 8]
            yield kind, a, b, (int(form_ok(kind, m["v"])), listed(kind, m["v"], before), in_context(kind, before), quoted(m["v"], before, after))
            new.append((a, b))
        if new:
            starts, ends = merged([*zip(starts, ends, strict=True), *new])


#: Numbers of a span as kept: kind, start and end; of a proposal also its
#: pattern, whose votes are digits to the base 3.
BASE_SIZE, MORE_SIZE = 3, 4


def code_of(pattern: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**n for n, v in enumerate(pattern))


def pattern_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**n % 3 - 1 for n in range(PATTERN_SIZE))


def searched(text: str) -> bytes:
    """All base spans and proposals of a text: the number of the former, then
    BASE_SIZE numbers for each, then MORE_SIZE for each of the others."""
    base = base_spans(text)
    more = [x for k, a, b, p in proposals(text, base) for x in (KINDS.index(k), a, b, code_of(p))]
    return np.array([len(base), *(x for k, a, b in base for x in (KINDS.index(k), a, b)), *more], dtype="<i4").tobytes()


def kept_parts(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The base spans and the proposals of searched(), a row each."""
    x = np.frombuffer(found, dtype="<i4")
    end = 1 + BASE_SIZE * int(x[0])
    return x[1:end].reshape(-1, BASE_SIZE), x[end:].reshape(-1, MORE_SIZE)


@dataclass
class Model:
    """Reliabilities by kind and labeler, the classifier's weights, and its
    score of each kind and pattern."""

    reliability: dict[str, dict[str, list[float]]] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    scores: dict[tuple, float] = field(default_factory=dict)

    def score(self, kind: str, pattern: tuple[int, ...]) -> float:
        if not self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_design([kind], [pattern])[0] @ np.array(self.weights), -30, 30))))


def _design(kinds: list[str], patterns: list[tuple[int, ...]]) -> np.ndarray:
    """Features of the classifier: each vote for and against, how many are for,
    and the kind."""
    p = np.array(patterns, dtype=np.float64).reshape(len(patterns), PATTERN_SIZE)
    many = (p == 1).sum(1, keepdims=True)
    kind = np.array([[k == x for x in ADDED] for k in kinds], dtype=np.float64)
    return np.concatenate([np.ones((len(p), 1)), p == 1, p == 0, many >= 2, many >= 3, kind], axis=1)


def expectation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that spans of a pattern are true, the votes' rates for (row
    0: on false spans, row 1: on true ones), and the share of true spans. Votes
    of -1 say nothing. Rates start from labelers that are right more often than
    not, and carry a weak prior for that, so that kinds with few spans keep it."""
    m = patterns.shape[1]
    rates = np.array([[0.2] * m, [0.8] * m])
    prior = 0.5
    prior_for, prior_all = np.array([[2.0] * m, [8.0] * m]), 10.0
    for _ in range(rounds):
        log = np.stack([np.log(1 - prior) * np.ones(len(patterns)), np.log(prior) * np.ones(len(patterns))])
        for y in (0, 1):
            log[y] += (np.where(patterns == 1, np.log(rates[y]), 0) + np.where(patterns == 0, np.log(1 - rates[y]), 0)).sum(1)
        true = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        old, prior = prior, float(((counts * true).sum() + 5) / (counts.sum() + 10))
        for y, w in ((0, counts * (1 - true)), (1, counts * true)):
            voted = w[:, None] * (patterns >= 0)
            rates[y] = np.clip(((w[:, None] * (patterns == 1)).sum(0) + prior_for[y]) / (voted.sum(0) + prior_all), 0.01, 0.99)
        if abs(old - prior) < 1e-9:
            break
    return true, rates, prior


def train(counted: Iterable[tuple[str, tuple[int, ...], int]]) -> Model:
    """The model of counted proposals (kind, pattern, number)."""
    model, rows, soft = Model(), sorted(counted), []
    for kind in sorted({k for k, _, _ in rows}):
        own = [(p, n) for k, p, n in rows if k == kind]
        counts = np.array([n for _, n in own], dtype=np.float64)
        true, rates, prior = expectation(np.array([p for p, _ in own]), counts)
        model.reliability[kind] = {"false": rates[0].tolist(), "true": rates[1].tolist(), "share": [prior]}
        soft += zip([kind] * len(own), (p for p, _ in own), counts, true, strict=True)
    if not soft:
        return model
    kinds, patterns, counts, true = map(list, zip(*soft, strict=True))
    # Shares of all proposals, so that size alone changes nothing.
    x, weight, t = _design(kinds, patterns), TRAIN_WEIGHT * np.array(counts) / np.sum(counts), np.array(true)
    w = np.zeros(x.shape[1])
    for _ in range(100):  # Newton steps on soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (t - p)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w.tolist()
    model.scores = {(k, p): model.score(k, p) for k, p in zip(kinds, patterns, strict=True)}
    return model


def _search(text: str) -> Column:
    """searched() of a column."""

    @F.pandas_udf("binary")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([searched(t or "") for t in texts], dtype="object")

    return found(F.col(text))


def fit(found: DataFrame) -> Model:
    """The model of what was found (the column `found`): patterns of all
    proposals are counted, by kind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            parts = [kept_parts(x.as_py())[1][:, [0, 3]] for x in b.column(0)]
            if parts:
                pairs, n = np.unique(np.concatenate(parts), axis=0, return_counts=True)
                for (k, p), m in zip(pairs.tolist(), n.tolist(), strict=True):
                    seen[k, p] = seen.get((k, p), 0) + m
        if seen:
            kinds, codes = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(codes, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["kind", "code", "n"])

    rows = found.select("found").mapInArrow(count, "kind int, code int, n long")
    counted = rows.groupBy("kind", "code").agg(F.sum("n").alias("n")).collect()  # 3**4 patterns for each kind at most
    return train((KINDS[r.kind], pattern_of(r.code), r.n) for r in counted)


def decide(found: bytes, model: Model, threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of what was found, by start and kind."""
    base, more = kept_parts(found)
    spans = [(a, k, b) for k, a, b in base.tolist()]
    added = []
    for k, a, b, code in more.tolist():
        key = KINDS[k], pattern_of(code)
        if (model.scores[key] if key in model.scores else model.score(*key)) >= threshold:
            added.append((a, k, b))
    in_order = lambda x: [(KINDS[k], a, b) for a, k, b in sorted(x)]
    return in_order(spans), in_order(spans + added)


def spans_of(text: str, model: Model, threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, by start and kind."""
    return decide(searched(text), model, threshold)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if b > at:
            out += [text[at : max(a, at)], f"<{kind.upper()}>"]
            at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, with_text: bool = False) -> DataFrame:
    """Spans of every row: doc_id, counts of the base kinds, the base spans,
    all spans and their number; the text with all of them replaced, if asked."""
    texts = docs.select("doc_id", whole_text().alias("text"))
    kept = cut(texts.select("doc_id", *(["text"] if with_text else []), _search("text").alias("found")))
    model = fit(kept) if model is None else model
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "n_spans", "base_spans", "spans", *(["redacted"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                rows = []
                for n, x in enumerate(part.column(1)):
                    base, every = decide(x.as_py(), model, threshold)
                    rows.append((*(sum(s[0] == k for s in base) for k in BASE), len(every), joined(base), joined(every), *([redact(part.column(2)[n].as_py(), every)] if with_text else [])))
                columns = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), *columns], names=names)

    schema = ", ".join([f"doc_id {kind.simpleString()}", *(f"{n} {'long' if n[:2] == 'n_' else 'string'}" for n in names[1:])])
    return kept.select("doc_id", "found", *(["text"] if with_text else [])).mapInArrow(run, schema)


def mask(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span in a text replaced by its kind; null texts stay
    null; n_chars, if there, follows the text; other columns as they are."""
    name = fresh_name(docs, "found")
    kept = cut(docs.withColumn("text", F.col("text").cast("string")).withColumn(name, _search("text")))
    model = fit(kept.select(F.col(name).alias("found")))

    @F.pandas_udf("string")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([None if t is None else redact(t, decide(x, model, threshold)[1]) for t, x in zip(texts, found, strict=True)], dtype="object")

    out = kept.withColumn("text", clean("text", name))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop(name)
