"""Personal data by weak supervision (operator 6), in DataFrame functions only.

Base patterns find emails, IP addresses, cards and phone numbers; matches that fail
their check (octets, Luhn, number of digits) are no base spans. The method may add
spans: candidates are the failing matches and looser patterns (emails and phone numbers
written in other ways). Labelers vote on every candidate: shape (regex), validity,
public registers (top domains, networks, issuers, country and area codes), context words
before and behind it, and what it is set off by. A labeler that has nothing to say abstains (0). Candidates with the same
votes are counted together, over all documents; from these counts, whose number is bounded
by the number of vote patterns, expectation-maximisation estimates each labeler's
reliability within each kind, base spans being known to be true, with what all kinds
together tell of the labeler as the prior. No labeler is trusted more than another from the
start, and what is only held to be true weighs no more than the base spans of its kind. A logistic span classifier is fitted to the estimated labels and applied to all
candidates as a column expression.

Positions count code points; ends are exclusive.

Edge cases: null text counts as empty. The given columns stay, but for one of the name of
the candidates, which is replaced. A document without candidates has no spans.
Without any candidate at all, no span is added. Texts are taken whole. The patterns
are written so that Java's matcher neither recurses on long matches nor tries a run
of characters from each of its places. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["shape", "valid", "listed", "near", "apart"]
LENGTHS = 8  # buckets of a candidate's length

# The base patterns. As given, but for possessive repeats where nothing
# follows that could need less, and a start at a run's start or where the match before
# ended, since no later start in a run can match if its first cannot.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{12,}", "phone": r"\+[0-9]"}
#: Looser forms, found apart from the base ones.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[(\[] ?at ?[)\]] ?[a-z0-9-]++(?: ?[(\[] ?dot ?[)\]] ?[a-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
LOOSE_GUARD = {"email": r"(?i)[(\[] ?at ?[)\]]", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
# Public registers, as what is listed and what is known not to be. Top domains:
# two letters are a country's, and the common others. Addresses: networks that are no hosts of
# the public network (this network, loopback, link-local, multicast, reserved), and those for
# private use, shared space and documentation, of which nothing is said. Cards: the issuers'
# first digits with their lengths. Phones: country codes, and North American area and
# exchange codes, which begin with 2 to 9.
_TOP = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|asia|post|app|dev|cloud|online|site|shop|store|tech|blog|xyz|email|agency|company|digital|live|news|world"
_OWN_NETWORKS = r"10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|198\.1[89]\."
_NO_HOSTS = r"0+\.|127\.|169\.254\.|22[4-9]\.|2[3-9][0-9]\.|[3-9][0-9][0-9]\."
_COUNTRY = "1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9]"
_ISSUER = r"4([0-9]{12}|[0-9]{15}|[0-9]{18})|(5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|(6011|64[4-9][0-9]|65[0-9]{2}|62[0-9]{2})[0-9]{12,15}|(30[0-5]|309|36[0-9]|3[89][0-9])[0-9]{11,16}|35(2[89]|[3-8][0-9])[0-9]{12,15}"
LISTED = {
    "email": (rf"(?i)(\.|[)\]] ?)({_TOP})$", r"(?i)(\.|[)\]] ?)(?!({_TOP})$)[a-z0-9-]+$".replace("{_TOP}", _TOP)),
    "ip": (rf"^(?!{_OWN_NETWORKS}|{_NO_HOSTS})", rf"^({_NO_HOSTS})"),
    "card": (rf"^({_ISSUER})$", rf"^(?!({_ISSUER})$)"),
    "phone": (rf"^(\+({_COUNTRY})|\(?[2-9][0-8][0-9]\)?[ .-][2-9])", rf"^(\+(?!{_COUNTRY})|\(?([01][0-9][0-9]|[2-9]9[0-9]|[2-9][0-8][0-9]\)?[ .-][01]))"),
}
SHAPE = {"email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]* ?[@(\[][^@]*[A-Za-z]$", "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", "card": r"^([0-9]{16}|[0-9]{15}|[0-9]{4}([ -][0-9]{4}){3})$", "phone": r"^(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{2,4}[ .-]?[0-9]{2,4}"}
#: Words before a candidate that speak for it, behind it, and before it that speak for something else.
NEAR = {
    "email": (r"(?i)\b(e-?mail|mail|contact|write|reach|correo|courriel|schreiben|escrib|adresse)", r"(?i)^\W{0,3}(is (my|the|our) (e-?mail|address)|\(?(e-?mail|work|home)\b)", r"(?i)\b(git|ssh|scp|repo|image|version)\W*$"),
    "ip": (r"(?i)\b(ip|address|host|server|client|login|adresse|direcci|rechner|servidor|serveur)", r"(?i)^\W{0,3}(is (my|the|our) (ip|host|server)|port\b|:[0-9]{2,5}\b)", r"(?i)\b(version|release|v|section|chapter|build|kapitel|abschnitt|secci.n)\W*$"),
    "card": (r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment|pay|karte|carte|tarjeta)", r"(?i)^\W{0,3}(exp|cvv|cvc|valid|is (my|the) card)", r"(?i)\b(isbn|order|invoice|serial|tracking|reference|ref|number|id|part|bestellung|pedido|commande)\W*$"),
    "phone": (r"(?i)\b(phone|tel|call|mobile|cell|fax|dial|ring|whatsapp|telefon|t.l.phone|tel.fono|anrufen|llam|appele)", r"(?i)^\W{0,3}(is (my|the|our) (number|phone|mobile)|\(?(mobile|cell|home|work|office|ext)\b)", r"(?i)\b(isbn|order|invoice|serial|tracking|part|id|sku)\W*$"),
}


def _with(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(sizes: Column, block: int = 256) -> Column:
    """Sums of the elements before each, block by block."""

    def before(a: Column) -> Column:
        add = lambda acc, x: F.struct(F.concat(acc["at"], F.array(acc["sum"])).alias("at"), (acc["sum"] + x).alias("sum"))
        start = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("bigint").alias("sum"))
        return F.aggregate(a, start, add)

    def blocks(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda i: before(F.slice(a, i * block + 1, block)))
        return _with(parts, lambda ps: _with(before(F.transform(ps, lambda p: p["sum"]))["at"], lambda offs: F.flatten(F.zip_with(ps, offs, lambda p, o: F.transform(p["at"], lambda x: x + o)))))

    return F.when(F.size(sizes) > 0, blocks(sizes)).otherwise(F.array().cast("array<bigint>"))


_FOUND = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string,behind:string>>"


def _found(text: Column, pattern: str, guard: str) -> Column:
    """Matches with their places and what stands around them."""

    def places(pieces: Column) -> Column:
        def of(hits: Column) -> Column:
            steps = F.transform(hits, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("bigint"))
            return _with(
                _running(steps),
                lambda at: F.transform(
                    hits,
                    lambda m, i: F.struct(
                        (F.get(at, i) + F.length(F.get(pieces, i))).alias("start"),
                        (F.get(at, i) + F.length(F.get(pieces, i)) + F.length(m)).alias("end"),
                        m.alias("text"),
                        F.right(F.get(pieces, i), F.lit(40)).alias("before"),
                        F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"),
                        F.left(F.get(pieces, i + 1), F.lit(25)).alias("behind"),
                    ),
                ),
            )

        return _with(F.regexp_extract_all(text, F.lit(pattern), 0), of)

    quick = F.contains(text, F.lit(guard)) if guard == "@" else text.rlike(guard)
    return F.when(quick, _with(F.split(text, pattern, -1), places).cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + _with(F.substring(digits, -i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)),
    )
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)  # there is nothing to check
    if kind == "ip":
        short = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    n = F.length(_digits(x))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(x))).otherwise(F.lit(False))
    return (n >= 10) & (n <= 15)


def _listed(kind: str, x: Column) -> Column:
    """1 for what the public registers have, -1 for what they can't have, 0 for neither."""
    told = _digits(x) if kind == "card" else x
    return F.when(told.rlike(LISTED[kind][0]), 1).when(told.rlike(LISTED[kind][1]), -1).otherwise(0)


def _vary(f, *args):
    """f of one column, the other arguments set."""
    return lambda x: f(x, *args)


def candidates(docs: DataFrame, text_col: str = "text", out_col: str = "candidates") -> DataFrame:
    """docs with an array of candidates: kind (its place in KINDS), start, end, base, a
    vote of -1, 0 or 1 of each labeler, and a bucket of its length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = []
    for k, kind in enumerate(KINDS):

        def seen(x: Column, base: bool, kind: str, k: int) -> Column:
            ok = _valid(kind, x["text"])
            vote = lambda c: F.when(c, 1).otherwise(-1)
            lead = F.right(x["before"], F.lit(1))
            return F.struct(
                F.lit(k).alias("kind"),
                x["start"].alias("start"),
                x["end"].alias("end"),
                (ok if base else F.lit(False)).alias("base"),
                vote(x["text"].rlike(SHAPE[kind])).alias("shape"),
                (F.lit(0) if kind == "email" else vote(ok)).alias("valid"),
                _listed(kind, x["text"]).alias("listed"),
                F.when(x["before"].rlike(NEAR[kind][0]) | x["behind"].rlike(NEAR[kind][1]), 1).when(x["before"].rlike(NEAR[kind][2]), -1).otherwise(0).alias("near"),
                vote(~lead.rlike(r"[\p{L}\p{N}_=\"]") & ~x["after"].rlike(r"[\p{L}\p{N}_\"]")).alias("apart"),
                F.least(F.lit(LENGTHS - 1), F.floor((x["end"] - x["start"]) / 4)).cast("int").alias("size"),
            )

        hits = _found(text, BASE[kind], GUARD[kind])
        if kind == "card":  # short runs of digits are no candidates
            hits = F.filter(hits, lambda x: F.length(_digits(x["text"])).between(13, 19))
        every.append(F.transform(hits, _vary(seen, True, kind, k)))
        if kind in LOOSE:
            every.append(F.transform(_found(text, LOOSE[kind], LOOSE_GUARD[kind]), _vary(seen, False, kind, k)))

    def clear(c: Column) -> Column:
        """Loose candidates that meet no base span."""
        sure = F.filter(c, lambda x: x["base"])
        return F.filter(c, lambda x: x["base"] | ~F.exists(sure, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

    return docs.withColumn(out_col, _with(F.concat(*every), clear))


def fit(rows: DataFrame, col: str = "candidates", rounds: int = 50) -> dict:
    """Reliabilities and the span classifier, from counts of vote patterns."""
    one = rows.select(F.explode(col).alias("c")).select("c.kind", "c.base", *[f"c.{v}" for v in LABELERS], "c.size")
    counts = one.groupBy("kind", "base", *LABELERS, "size").count().collect()  # at most 4 * 2 * 3**5 * 8 rows
    if not counts:
        return {"weights": None, "reliability": {}}
    counts = sorted(counts, key=tuple)
    kind = np.array([r["kind"] for r in counts])
    base = np.array([r["base"] for r in counts])
    votes = np.array([[r[v] + 1 for v in LABELERS] for r in counts])
    size = np.array([r["size"] for r in counts])
    n = np.array([r["count"] for r in counts], float)
    # Votes are taken to be right rather than wrong, as pseudo-counts.
    lean = np.repeat(np.array([[[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]]]), len(LABELERS), 0)  # by labeler and class: votes -1, 0, 1
    p = np.where(base, 1.0, 0.2)
    for _ in range(rounds):
        prior, seen = np.zeros(len(KINDS)), np.zeros((len(KINDS), *lean.shape))
        for k in range(len(KINDS)):
            own, rest = kind == k, (kind == k) & ~base
            prior[k] = (1 + (n * p)[rest].sum()) / (5 + n[rest].sum())
            # What is only held to be true weighs no more than what is known to be.
            trust = min(1.0, n[own & base].sum() / max(1e-9, (n * p)[rest].sum()))
            for j in range(len(LABELERS)):
                seen[k, j, 0] = np.bincount(votes[own, j], (n * (1 - p))[own], 3)
                seen[k, j, 1] = np.bincount(votes[own, j], (n * np.where(base, 1.0, p * trust))[own], 3)
        every = seen.sum(axis=0) + lean  # all kinds, which a kind's own votes outweigh
        table = seen + lean.sum(axis=2, keepdims=True) * every / every.sum(axis=2, keepdims=True)
        table /= table.sum(axis=3, keepdims=True)
        log = np.log(np.stack([1 - prior[kind], prior[kind]], 1))
        for j in range(len(LABELERS)):
            log += np.log(table[kind, j, :, votes[:, j]])
        p = np.where(base, 1.0, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50))))
    x = _features(kind, votes, size)
    w = np.zeros(x.shape[1])
    rows_w = n / n.max() + 1e-3
    for _ in range(60):  # Newton's method
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (rows_w * (q - p)) + 1e-3 * w
        hess = (x * (rows_w * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -3, 3)
    return {"weights": w.tolist(), "reliability": {KINDS[k]: {v: table[k, j].tolist() for j, v in enumerate(LABELERS)} for k in range(len(KINDS))}}


def _features(kind: np.ndarray, votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One column for each kind, each vote of each labeler within each kind, and each
    bucket of length."""
    cols = [kind == k for k in range(len(KINDS))]
    cols += [(kind == k) & (votes[:, j] == v) for k in range(len(KINDS)) for j in range(len(LABELERS)) for v in range(3)]
    cols += [size == s for s in range(LENGTHS)]
    return np.array(cols, float).T


def _score(c: Column, weights: list[float]) -> Column:
    """The classifier's sum for one candidate, by looking its weights up."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = len(LABELERS) * 3
    parts = [F.get(w, c["kind"])]
    parts += [F.get(w, F.lit(len(KINDS) + 3 * j + 1) + c["kind"] * per + c[v]) for j, v in enumerate(LABELERS)]
    parts += [F.get(w, F.lit(len(KINDS) * (1 + per)) + c["size"])]
    return sum(parts[1:], parts[0])


def spans(model: dict, col: str = "candidates", threshold: float = 0.5) -> Column:
    """Sorted distinct spans struct(start, kind, end, base) of a document's candidates:
    base ones, and those that the classifier takes."""
    c = F.col(col)
    if model["weights"] is None:
        kept = F.filter(c, lambda x: x["base"])
    else:
        at = float(np.log(threshold / (1 - threshold)))
        kept = F.filter(c, lambda x: x["base"] | (_score(x, model["weights"]) >= at))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base")))))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; spans that meet count as
    one, of the first one's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(found: Column) -> Column:
        # The end of each span, or of an earlier one that reaches further.
        far = F.aggregate(
            found,
            F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (x["start"] < F.element_at(acc, -1)["end"]),
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.element_at(acc, -1)["kind"].alias("kind"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
            ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["kind"].cast("int").alias("kind"), x["end"].alias("end"))))),
        )
        return _with(
            far,
            lambda a: F.concat(
                F.array_join(F.transform(a, lambda x, i: _between(text, F.when(i > 0, F.get(a, i - 1)["end"]).otherwise(F.lit(0)), x["start"], F.get(names, x["kind"]))), ""),
                F.substring(text, (F.element_at(a, -1)["end"] + 1).cast("int"), F.length(text)),
            ),
        )

    return F.when(F.size(spans) > 0, cut(spans)).otherwise(text)


def _between(text: Column, start: Column, end: Column, then: Column) -> Column:
    return F.concat(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")), then)
