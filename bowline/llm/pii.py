"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (``BASE``) come from fixed rules, leftmost and non-overlapping per
kind, and always stay. Candidates (``candidates``) are the base spans and wider
finds: addresses spelled with "at" and "dot", phone and card numbers inside
digit runs that a base rule took whole and dropped, national phone formats,
IPv6, IBAN, social security numbers, and names after a title or from a list.

1. Six labelers vote yes, no or abstain on every candidate: a strict pattern,
   a checksum or range, a gazetteer, cue words for and against in the text
   before it, and its edges.
2. Votes are counted over the whole corpus. Per kind, expectation-maximisation
   over these counts estimates each labeler's rates of yes, no and abstention
   on true and on false candidates, and the share of true ones. Rates start
   from a labeler that is right more often than not and are held there by
   ``PRIOR`` pseudo-counts, so the classes cannot change sides.
3. The posteriors are soft labels for one logistic regression a kind over
   ``FEATURES`` shape, context and check features, which is the final classifier. A
   candidate outside the base rules becomes a span where its probability is
   ``THRESHOLD`` or more; of overlapping ones the likelier stays (then the
   longer, then the earlier), and none overlaps a base span.

Scale. Texts are read twice, once to count and once to find, and never
shuffled. A task sums its counts of (kind, votes, features) and emits them
once. EM works on at most 3**6 vote patterns a kind. The regression is fitted
on at most ``MOST_PATTERNS`` distinct (kind, votes, features), the most
frequent ones, each with its count. Every rule is linear in the text.

Nulls and edges: a null or empty text has no spans. Positions are code points,
end exclusive. Repeated rows give repeated results; ids may be null or repeated
and are not looked at. Without candidates of a kind its classifier says no. An
empty table gives an empty result. Very long texts are searched whole. Only
the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import ipaddress
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bowline.functions.common import let
from bowline.llm.tables import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "name", "ssn")
LABELERS = 6
ABSTAIN, NO, YES = 0, 1, 2
FEATURES = 17
PRIOR = 20.0
ROUNDS = 200
THRESHOLD = 0.5
MOST_PATTERNS = 20_000
REACH = 32  # characters before a candidate that cue words are looked for in

# fixed values: the base rules; possessive, because no shorter run can match where the longest fails
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: wider finds; each begins with a character class and looks back after it, so that texts are skimmed quickly
BRACKET_AT = re.compile(r"[\[({]\s?(?:at|AT|@)\s?[\])}]\s?")
SPELLED_AT = re.compile(r"\x20(?:at|AT)\x20(?=[A-Za-z0-9-]+\x20(?:dot|DOT)\x20)")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]++)++")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?=\s?\Z)")
INNER_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){1,2}(?![0-9])")
NATIONAL = re.compile(r"[0-9(](?<![\w+.)-].)(?:(?<=\()[0-9]{3}\)\x20?|(?<=[0-9])[0-9]{2}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![\w-])")
TRUNK = re.compile(r"0(?<![\w+.-].)[0-9]{1,4}[\x20/-][0-9]{5,8}(?![\w-])")
CARD_SHAPES = ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3))
IPV6 = re.compile(r"[0-9A-Fa-f:](?<![\w:.].)[0-9A-Fa-f:]{5,38}(?![\w:.])")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"[0-9](?<![\w-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![\w-])")
BEFORE_NAME = re.compile(r"[A-ZÀ-Þ](?<!\w.)[^\W\d_]*+[.,]?\s(?=[A-ZÀ-Þ])")
CAPITALS = re.compile(r"[A-ZÀ-Þ][^\W\d_A-Z]+(?:\x20[A-ZÀ-Þ][^\W\d_A-Z]+){0,2}")
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Dear Sincerely Regards".split())

# fixed values: gazetteers
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app ai de fr es it nl be ch at uk eu us ca mx br ar cl au nz "
                      "in cn jp kr ru pl cz se no fi dk pt gr ie tr za".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                    "81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 380 420 421".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38")
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
               "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
FIRST_NAMES = frozenset(
    "Alice Andrea Andreas Anna Antonio Barbara Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emma "
    "François Hans Heinz Helga Ingrid Isabel Jacques James Jean Jennifer Joachim John José Juan Julia Jürgen Karin Klaus "
    "Laura Linda Lucía Luis Manuel Maria Marie Mark Martin Mary Michael Michel Miguel Monika Nathalie Nicole Patricia Paul "
    "Pedro Peter Philippe Pierre Pilar Richard Robert Sabine Sarah Sophie Stefan Susan Sylvie Thomas Ursula William Wolfgang".split())
CUES = {
    "email": ("mail", "contact", "write to", "reach", "correo", "courriel"), "ip": ("ip", "addr", "host", "server", "client"),
    "card": ("card", "visa", "master", "amex", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "cell", "rufnummer", "sms"), "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "name": ("name", "mr", "mrs", "ms", "dr", "herr", "frau", "dear", "signed", "author", "regards"),
    "ssn": ("ssn", "social", "security", "tax"),
}
AGAINST = ("version", "isbn", "order", "total", "page", "section", "build", "release", "serial", "item", "no.", "#", "$", "€", "sha", "key",
           "token", "secret", "hash", "id=", "v.")


def luhn(digits: str) -> bool:
    odd = digits[::-1]
    return (sum(map(int, odd[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in odd[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            done = domain.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(the spans that the base rules find, the card and phone matches that they drop)."""
    found = [("email", s, e) for s, e in _emails(text)]
    dropped = []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            d = _digits(m[0])
            good = least <= len(d) <= most and (kind == "phone" or luhn(d))
            (found if good else dropped).append((kind, *m.span()))
    return found, dropped


def _cards_within(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Digit groups of a dropped run that have the shape of a card."""
    groups = [m.span() for m in re.finditer("[0-9]+", text[start:end])]
    sizes = [e - s for s, e in groups]
    for i, (s, e) in enumerate(groups):
        if 13 <= sizes[i] <= 19:
            yield "card", start + s, start + e
        for shape in CARD_SHAPES:
            if tuple(sizes[i:i + len(shape)]) == shape:
                yield "card", start + s, start + groups[i + len(shape) - 1][1]


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, wider candidates that touch none of them)."""
    base, dropped = base_spans(text)
    more = []
    for kind, s, e in dropped:
        if kind == "card":
            more += _cards_within(text, s, e)
        else:
            more += [("phone", *m.span()) for m in INNER_PHONE.finditer(text, s, e)]
    spelled = [BRACKET_AT] + [SPELLED_AT] * (" dot " in text or " DOT " in text)
    for m in (m for pattern in spelled for m in pattern.finditer(text)):
        before = max(0, m.start() - 65)
        local, domain = LOCAL_TAIL.search(text[before:m.start()]), SPELLED_DOMAIN.match(text, m.end())
        if local and domain:
            more.append(("email", before + local.start(), domain.end()))
    for kind, pattern in (("phone", NATIONAL), ("phone", TRUNK), ("ssn", SSN), ("iban", IBAN)):
        more += [(kind, *m.span()) for m in pattern.finditer(text)]
    if "::" in text or text.count(":") > 6:
        more += [("ip", *m.span()) for m in IPV6.finditer(text) if m[0].count(":") > 1]
    for m in BEFORE_NAME.finditer(text):
        word = m[0].rstrip(".,\n\t\r ")
        at = m.end() if word in TITLES else m.start() if word in FIRST_NAMES else None
        if at is not None and (n := CAPITALS.match(text, at)):
            more.append(("name", *n.span()))
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    free = []
    for c in dict.fromkeys(more):
        k = int(np.searchsorted(starts, c[2]))  # base spans that start before its end
        if k == 0 or reach[k - 1] <= c[1]:
            free.append(c)
    return base, free


# ---- labelers ----------------------------------------------------------------

STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\s?\W\s?(?:at|AT|@)\s?\W\s?|\x20(?:at|AT)\x20)\S.*"),
    "ip": re.compile(r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})|[0-9A-Fa-f:]+"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{4}){2}(?:\1[0-9]{1,3})?|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20./-]?[0-9]{2,8}){1,4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"),
    "name": re.compile(r"\S+(?:\x20\S+){1,2}"), "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
}


def _vote(yes) -> int:
    return YES if yes else NO


def _checked(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "card":
        return _vote(13 <= len(d) <= 19 and luhn(d))
    if kind == "phone":
        return _vote(9 <= len(d) <= 15)
    if kind == "iban":
        whole = s.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in whole[4:] + whole[:4])
        return _vote(IBAN_LENGTH.get(whole[:2], len(whole)) == len(whole) and int(number) % 97 == 1)
    if kind == "ip":
        try:
            return _vote(ipaddress.ip_address(s))
        except ValueError:
            return NO
    return ABSTAIN


def _listed(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "email":
        return _vote(re.split(r"[^A-Za-z0-9-]+|\x20", s.strip(")]} "))[-1].lower() in TOP_LEVEL)
    if kind == "card":
        return _vote(d.startswith(ISSUERS))
    if kind == "phone":
        return _vote(any(d[:n] in CALLING for n in (1, 2, 3))) if s[0] == "+" else _vote(d[0] == "0" or d[0] > "1" and d[3:4] > "1")
    if kind == "iban":
        return _vote(s[:2] in IBAN_LENGTH)
    if kind == "name":
        return _vote(s.split(" ")[0] in FIRST_NAMES)
    return ABSTAIN


def _edge(text: str, start: int, end: int) -> int:
    """Whether the candidate stands by itself and is not a part of a longer token."""
    left, right = text[max(0, start - 1):start], text[end:end + 2]
    joined = (left.isalnum() or left in tuple("_/=-.") or right[:1].isalnum() or right[:1] in tuple("_/=")
              or (right[:1] in tuple("-.") and right[1:].isalnum()))
    return _vote(not joined)


def votes(kind: str, text: str, start: int, end: int) -> int:
    """The labelers' votes, one base-3 digit each."""
    s, left = text[start:end], text[max(0, start - REACH):start].lower()
    out = 0
    for v in (_vote(STRICT[kind].fullmatch(s)), _checked(kind, s), _listed(kind, s),
              YES if any(c in left for c in CUES[kind]) else ABSTAIN, NO if any(c in left for c in AGAINST) else ABSTAIN,
              _edge(text, start, end)):
        out = 3 * out + v
    return out


def features(kind: str, text: str, start: int, end: int) -> int:
    """Shape, context and checks of a candidate, one bit each."""
    s, left = text[start:end], text[max(0, start - REACH):start].lower()
    d, before, after = _digits(s), text[start - 1:start] if start else "", text[end:end + 1]
    bits = (s[0] == "+", "(" in s, " " in s, "-" in s, "." in s, ":" in s, len(d) == len(s), len(d) >= 9, len(d) >= 13, len(set(d)) >= 4,
            before == "" or before.isspace(), after == "" or after.isspace() or after in ",.;!?)",
            any(c in left for c in CUES[kind]), any(c in left for c in AGAINST),
            _checked(kind, s) == YES, _checked(kind, s) == NO, _listed(kind, s) == YES)
    return sum(1 << i for i, b in enumerate(bits) if b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for t in batch.column(0):
            text = t.as_py() or ""
            base, more = candidates(text)
            seen.update((k, votes(k, text, s, e), features(k, text, s, e)) for k, s, e in base + more)
            if len(seen) > MOST_PATTERNS:
                yield _counted(seen)
                seen.clear()
    if seen:
        yield _counted(seen)


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _, _ in seen]), pa.array([v for _, v, _ in seen], pa.int32()),
         pa.array([f for _, _, f in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
        names=["kind", "votes", "features", "n"])


def count_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, features, n) of all candidates of all texts."""
    return (docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "kind string, votes int, features int, n long")
            .groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")))


# ---- reliabilities and the classifier ------------------------------------------

def _rows(v: np.ndarray) -> np.ndarray:
    """Vote of every labeler from the base-3 numbers."""
    return np.stack([v // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)], axis=1)


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of every vote pattern, rates[class, labeler, vote], share of true candidates)."""
    rows = _rows(v)
    # fixed values: a labeler's rates before any data: abstain, no, yes on false and on true candidates
    start = np.array([[0.4, 0.4, 0.2], [0.4, 0.1, 0.5]])
    rates = np.repeat(start[:, None, :], LABELERS, axis=1)
    share, post = 0.5, np.zeros(len(v))
    at = np.arange(LABELERS)
    for _ in range(rounds):
        log = np.log(rates[:, at, rows]).sum(axis=2)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - share) / share), -500, 500)))
        for c, w in ((0, n * (1 - new)), (1, n * new)):
            counts = np.stack([np.bincount(rows[:, j], w, 3) for j in at])
            rates[c] = (counts + PRIOR * start[c]) / (counts.sum(axis=1, keepdims=True) + PRIOR)
        share = float(((n * new).sum() + 1) / (n.sum() + 2))
        moved, post = np.abs(new - post).max(initial=0.0), new
        if moved < 1e-9:
            break
    return post, rates, share


def _design(f: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(f), 1)), (f[:, None] >> np.arange(FEATURES)) & 1], axis=1).astype(np.float64)


def regression(f: np.ndarray, p: np.ndarray, n: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression of soft labels ``p`` with counts ``n`` (Newton's method)."""
    x = _design(f)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - q)) - penalty * w
        curve = (x * (n * q * (1 - q))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


Model = dict[str, np.ndarray]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """One classifier a kind, from the labelers' votes on all candidates of ``docs``."""
    patterns = materialize(count_patterns(docs, text_col), "patterns")
    by_votes = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    often = patterns.orderBy(F.desc("n"), "kind", "votes", "features").limit(MOST_PATTERNS).collect()
    model = {}
    for kind in KINDS:
        seen = [r for r in by_votes if r["kind"] == kind]
        if not seen:
            continue
        v, n = (np.array([r[c] for r in seen], np.int64) for c in ("votes", "n"))
        post = dict(zip(v.tolist(), expectation_maximisation(v, n.astype(np.float64))[0]))
        rows = [r for r in often if r["kind"] == kind]
        if rows:
            model[kind] = regression(np.array([r["features"] for r in rows]), np.array([post[r["votes"]] for r in rows]),
                                     np.array([r["n"] for r in rows], np.float64))
    return model


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,p:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("p", pa.float64())])


def spans_of(text: str, model: Model) -> list[dict]:
    base, more = candidates(text)

    def judged(found: list, of_base: bool) -> list[dict]:
        out = []
        for k, s, e in found:
            w = model.get(k)
            z = -np.inf if w is None else float((_design(np.array([features(k, text, s, e)])) @ w)[0])
            out.append({"kind": k, "start": s, "end": e, "base": of_base, "p": float(1 / (1 + np.exp(np.clip(-z, -500, 500))))})
        return out

    likely = sorted((x for x in judged(more, False) if x["p"] >= THRESHOLD),
                    key=lambda x: (-x["p"], x["start"] - x["end"], x["start"], KINDS.index(x["kind"])))
    held, added = bytearray(len(text)) if likely else b"", []
    for x in likely:
        if not any(held[x["start"]:x["end"]]):
            held[x["start"]:x["end"]] = b"\1" * (x["end"] - x["start"])
            added.append(x)
    return sorted(judged(base, True) + added, key=lambda x: (KINDS.index(x["kind"]), x["start"]))


def _find(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [spans_of(t.as_py() or "", model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])
    return run


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row, spans in the order of ``KINDS`` and then of their starts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_find(model), f"doc_id {kind}, spans {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[{}]") -> Column:
    """The text with every span replaced by its kind; of overlapping spans the first stands for both."""
    pieces = let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))), lambda xs: F.aggregate(
        xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
        .otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
            F.format_string(mark.replace("{}", "%s"), s["kind"]))).alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))))
    return pieces
