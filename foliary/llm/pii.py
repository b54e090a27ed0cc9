"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are the base patterns' spans and looser forms (masked addresses, numbers without the
international prefix, other separators). Regex, gazetteer and context labelers vote on each
candidate for or against, or abstain. Expectation-maximisation over the vote counts of the whole
corpus estimates how reliable each labeler is, and the resulting posteriors train a logistic span
classifier on the candidate's form and surroundings. Base spans always stay; the classifier
decides about the others.

Only counts of (kind, votes, features) leave the executors. Their number is bounded by the finite
sets of votes and features, whatever the size of the data.

Edge cases: a null text counts as empty and has no spans; repeated rows are treated alike; an
empty table gives an empty result; other columns are never read. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, texts_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A match always begins and ends with a whole run of digits, so none can begin within one.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms, as (kind, name, pattern).
LOOSE = (
    ("email", "masked", re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("ip", "defanged", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])")),
    ("card", "dotted", re.compile(r"(?<![0-9./-])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9./-])")),
    ("phone", "national", re.compile(r"(?<![0-9+)./-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")),
    ("phone", "prefixed", re.compile(r"(?<![0-9+)./-])00[1-9][0-9\x20-]{7,16}[0-9](?![0-9-])")),
)
FORMS = ("base", *(name for _, name, _ in LOOSE))

# Gazetteers and context words.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co de fr es uk us it nl eu ch at be ca au in jp cn ru br mx pl se no".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "62", "22", "23", "24", "25", "26", "27")
HINTS = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt adresse address".split()),
    "ip": frozenset("ip host server address addr from client login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit carte karte tarjeta payment".split()),
    "phone": frozenset("tel phone call mobile fax cell telephone telefon teléfono téléphone anruf".split()),
}
AGAINST = frozenset("version release isbn order invoice sku part build id no. section chapter".split())
WORD = re.compile(r"[^\W\d_][\w.-]*")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, whatever the number of leading zeros."""
    short = digits.lstrip("0") or "0"
    return len(short) < 4 and int(short) <= 255


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has one possible local part, the run before it: the same spans as a scan of the pattern."""
    begin = 0
    at = text.find("@")
    while at >= 0:
        window = max(begin, at - 256)
        local = EMAIL_LOCAL.search(text, window, at) if window < at else None
        while local and local.start() == window and window > begin:  # the run may be longer
            window = max(begin, window - 4 * (at - window))
            local = EMAIL_LOCAL.search(text, window, at)
        if local and (domain := EMAIL_DOMAIN.match(text, at + 1)):
            yield local.start(), domain.end()
            begin = domain.end()
        at = text.find("@", max(at + 1, begin))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the base patterns for each kind, in order; failing matches are dropped."""
    numbers = re.search("[0-9]", text)
    return [
        list(_emails(text)),
        [m.span() for m in IP.finditer(text) if all(octet(p) for p in m.group().split("."))] if numbers else [],
        [m.span() for m in CARD.finditer(text) if 16 <= m.end() - m.start() and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)] if numbers else [],
        [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15] if "+" in text else [],
    ]


def loose_spans(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(kind, form, start, end) of the looser forms that look valid."""
    if not re.search("[0-9]", text) and not re.search(r"[\[({]at[\])}]", text, re.I):
        return
    for form, (kind, name, pattern) in enumerate(LOOSE, 1):
        if name == "masked" and not re.search(r"[\[({]at[\])}]", text, re.I) or name == "defanged" and "[.]" not in text:
            continue
        for m in pattern.finditer(text):
            d = digits_of(m.group())
            if kind == "card" and not luhn(d) or kind == "ip" and not all(map(octet, m.group().split("[.]"))):
                continue
            yield KINDS.index(kind), form, *m.span()


def votes(kind: int, form: int, text: str, start: int, end: int) -> tuple[tuple[int, int, int], tuple[int, ...]]:
    """Votes of the regex, gazetteer and context labelers (1, 0 or -1), and the classifier's features."""
    span, name = text[start:end], KINDS[kind]
    around = [w.lower().rstrip(".") for w in WORD.findall(text[max(0, start - 40) : start])[-4:]]
    if name == "email":
        parts = re.split(r"@|\x20?[\[({]at[\])}]\x20?", span, flags=re.I)
        strict = bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*", parts[0])) and ".." not in span
        known = 1 if re.split(r"[.\x20\])}]+", span)[-1].lower() in TOP_LEVEL else -1
    elif name == "ip":
        parts = re.split(r"[\[\].]+", span)
        strict = all(p == "0" or not p.startswith("0") for p in parts)
        first = int(parts[0].lstrip("0") or 0)
        known = 1 if first not in (0, 127) and first < 224 else -1
    elif name == "card":
        strict = len(digits_of(span)) == 16 or len(set(re.sub("[0-9]", "", span))) < 2
        known = 1 if digits_of(span).startswith(ISSUERS) else -1
    else:
        number = digits_of(span).removeprefix("00")
        strict = 10 <= len(number) <= 13
        known = (1 if number.startswith(CALLING_CODES) else -1) if form in (0, FORMS.index("prefixed")) else 0
    near = set(around)
    context = 1 if near & HINTS[name] else -1 if near & AGAINST else 0
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    return (1 if strict else -1, known, context), (form, int(left.isalnum()), int(right.isalnum()), context + 1, known + 1)


def scan(text: str | None) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int, str]]]:
    """Base spans, and every candidate as (kind, start, end, key of its votes and features)."""
    text = text or ""
    base = base_spans(text)
    found = [(k, 0, s, e) for k, spans in enumerate(base) for s, e in spans]
    taken = sorted((s, e) for _, _, s, e in found)
    starts = [s for s, _ in taken]
    furthest = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    for k, form, s, e in loose_spans(text):
        at = int(np.searchsorted(starts, e)) if starts else 0
        if not at or furthest[at - 1] <= s:  # apart from every base span
            found.append((k, form, s, e))
    out = []
    for k, form, s, e in found:
        v, f = votes(k, form, text, s, e)
        out.append((k, s, e, f"{k}|{' '.join(map(str, v))}|{' '.join(map(str, f))}"))
    return base, out


SCANNED = "doc_id long, n array<long>, base_sha256 string, candidates array<struct<kind:int,start:int,end:int,key:string>>"


def scan_documents(docs: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, rows = [], [], []
            for t in batch.column(1):
                base, found = scan(t.as_py())
                counts.append([len(x) for x in base])
                named = ",".join([f"{k}:{s}:{e}" for k, spans in zip(KINDS, base, strict=True) for s, e in spans])
                digests.append(hashlib.sha256(named.encode()).hexdigest())
                rows.append([dict(zip(("kind", "start", "end", "key"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.list_(pa.int64())), pa.array(digests, pa.string()), pa.array(rows, kind)],
                names=["doc_id", "n", "base_sha256", "candidates"],
            )

    return texts_of(pick(docs, "doc_id", "text"), F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM for one kind: the share of true candidates and P(vote | truth) of each labeler.

    ``counts`` has the number of candidates for each combination of votes. Starts from labelers
    that are right seven times in ten, which fixes which class is which; add-one smoothing.
    """
    patterns = np.array(list(counts)) + 1
    n = np.array(list(counts.values()), float)
    labelers = patterns.shape[1]
    share, table = 0.5, np.empty((2, labelers, 3))
    table[1], table[0] = (0.2, 0.3, 0.5), (0.5, 0.3, 0.2)
    for _ in range(rounds):
        truth = posterior(patterns, share, table)
        new = (truth @ n + 1) / (n.sum() + 2)
        for y, weight in ((1, n * truth), (0, n * (1 - truth))):
            for j in range(labelers):
                table[y, j] = np.bincount(patterns[:, j], weight, 3) + 1
                table[y, j] /= table[y, j].sum()
        if abs(new - share) < 1e-9:
            break
        share = new
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """P(true | votes) for rows of votes counted from zero."""
    j = np.arange(patterns.shape[1])
    one = np.log(share) + np.log(table[1][j, patterns]).sum(1)
    zero = np.log(1 - share) + np.log(table[0][j, patterns]).sum(1)
    return 1 / (1 + np.exp(np.clip(zero - one, -50, 50)))


def train(counts: dict[str, int]) -> set[str]:
    """The keys that the span classifier accepts, from the corpus's counts of keys."""
    accepted: set[str] = set()
    for kind in range(len(KINDS)):
        keys = [k for k in counts if k.startswith(f"{kind}|")]
        if not keys:
            continue
        votes_of = [tuple(map(int, k.split("|")[1].split())) for k in keys]
        totals: dict[tuple[int, ...], float] = {}
        for k, v in zip(keys, votes_of, strict=True):
            totals[v] = totals.get(v, 0) + counts[k]
        truth = posterior(np.array(votes_of) + 1, *reliabilities(totals))
        # Logistic regression on one-hot features, weighted by count, with soft targets.
        fields = np.array([list(map(int, k.split("|")[2].split())) for k in keys])
        sizes = (len(FORMS), 2, 2, 3, 3)
        x = np.concatenate([np.eye(s)[fields[:, j]] for j, s in enumerate(sizes)] + [np.ones((len(keys), 1))], 1)
        n, w = np.array([counts[k] for k in keys], float), np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (truth - p)) - w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        accepted |= {k for k, z in zip(keys, x @ w, strict=True) if z >= 0}
    return accepted


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans that stay."""
    scanned = cut(scan_documents(docs), "pii")
    keys = scanned.select(F.explode("candidates.key").alias("key")).groupBy("key").count()
    accepted = train({r["key"]: r["count"] for r in keys.orderBy("key").collect()})  # a finite set of keys
    loose = sorted(k for k in accepted if k.split("|")[2].split()[0] != "0")
    stays = lambda c: F.split(F.split(c["key"], r"\|")[2], " ")[0] == "0"
    if loose:
        extra = F.array(*[F.lit(k) for k in loose])
        kept = F.filter("candidates", lambda c: stays(c) | F.array_contains(extra, c["key"]))
    else:
        kept = F.filter("candidates", stays)
    ordered = F.sort_array(F.transform(kept, lambda c: F.struct(c["kind"].alias("k"), c["start"].alias("s"), c["end"].alias("e"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(ordered, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string")))
    return scanned.select(
        "doc_id", *[F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)], "base_sha256", F.array_join(spans, ",").alias("spans")
    )


def every_key() -> int:
    """Upper bound on the number of distinct keys."""
    return len(KINDS) * len(list(product((-1, 0, 1), repeat=3))) * len(FORMS) * 2 * 2 * 3 * 3
