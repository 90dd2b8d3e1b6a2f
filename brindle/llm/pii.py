"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Four base kinds are found by their patterns and always kept. High-recall generators propose more
spans, which may overlap each other: written-out addresses, bracketed or colon-separated network
addresses, digit runs of card length, national telephone numbers, and keys and tokens (a fifth kind, secret). Boosted trees score each
proposal by its format (lengths, digit and separator counts, check digit, how varied it is) and its context (words
before it, the characters around it); a calibrated threshold decides. Trees are fitted in
numpy on the driver, on synthetic texts made by the same DataFrame functions (a fixed number of
them), and become a column expression. Whole templates of these texts are held out of the fit; slope, shift and threshold
come from them.

Places are code points, end exclusive. Defined cases: a null or empty text has no spans, counts of
0 and the hash of the empty string; repeated rows are returned as often as they occur; columns
other than doc_id and text are ignored, whatever their names (``redact`` keeps them as they are).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base kinds, and the one that only the method finds.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "[A-Za-z0-9._%+-]"

#: Base patterns. Possessive where nothing can be gained by giving back, so that long runs take linear
#: time; an address begins where a run of its characters or the search itself begins.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

#: Generators of further proposals: kind, hint, pattern.
PROPOSE = (
    ("email", r"(?i)[\[({]\s?(?:at|@)\s?[\])}]", rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+\s?[\[({{]\s?(?:at|@)\s?[\])}}]\s?[A-Za-z0-9-]{{1,63}}(?:\s?(?:[\[({{]\s?(?:dot|\.)\s?[\])}}]|\.)\s?[A-Za-z0-9-]{{1,63}}){{1,4}}"),
    ("ip", r"(?:[0-9A-Fa-f]{1,4}:){7}|[0-9](?:\[\.\]|\(dot\))[0-9]", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:(?:\[\.\]|\(dot\)|\.)[0-9]{1,3}){3})(?![0-9A-Za-z:])"),
    ("card", r"[0-9](?:[\x20.-]?[0-9]){12}", r"(?<![0-9A-Za-z.-])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9A-Za-z])"),
    ("phone", r"[0-9][)]?[\x20./-][0-9]{2,4}[\x20./-][0-9]{2}", r"(?<![0-9A-Za-z.+/-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}(?![0-9A-Za-z/-])"),
    ("secret", r"(?i)(?:token|secret|passw|api.?key|bearer|credential|AKIA|ASIA|gh[pousr]_|sk-|xox[a-z]-|AIza|eyJ)", r"(?i)(?:(?<=(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|bearer|credential)[\"']?\s{0,2}[:= ]\s{0,2}[\"']?)[A-Za-z0-9_/+.=-]{12,}+|(?<![A-Za-z0-9_-])(?:AKIA|ASIA|gh[pousr]_|sk-|xox[a-z]-|AIza|eyJ)[A-Za-z0-9_./+=-]{12,}+)"),
)

_SPAN = "array<struct<start:int,end:int,match:string>>"
#: Characters of context before and behind a proposal.
CONTEXT = 32
_CUES = {
    "call": r"(?i)\b(?:tel|phone|fon|call|mobile|cell|fax|t[ée]l|m[óo]vil|whatsapp|reach|ring)\b",
    "mail": r"(?i)\b(?:e-?mail|mail|write|contact|correo|courriel|reach)\b",
    "card": r"(?i)\b(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay)\b",
    "secret": r"(?i)(?:token|secret|passwd|password|key|bearer|credential)\W{0,4}$",
    "assigned": r"[:=]\s{0,2}[\"']?$",
    "net": r"(?i)\b(?:ip|host|server|address|adresse|login|from|client)\b",
    "other": r"(?i)\b(?:order|invoice|part|serial|isbn|version|ref|no|nr|sku|ticket|date|lot|model|code|id)\b",
}


#: Matches of a text that are placed at once.
_BLOCK = 256


def _found(text: Column, pattern: str, hint: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, match): the gaps between them give the places.

    Places add up along the matches, a block of them at a time, so that many matches take about linear time.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    spans = lambda at: F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("spans"))

    def block(acc: Column, part: Column) -> Column:
        placed = F.aggregate(part, spans(acc["at"]), step)
        return F.transform(F.array(placed), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["blocks"], F.array(p["spans"])).alias("blocks")))[0]

    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    whole = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(_BLOCK)), lambda i: F.slice(p, i, F.lit(_BLOCK))))[0]
    return F.when(hint, F.aggregate(whole, zero, block, lambda acc: F.flatten(acc["blocks"]))).otherwise(F.array().cast(_SPAN))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the check digit holds."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    size = lambda s: F.length(_digits(s["match"]))
    return {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["match"].rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
        "card": lambda s: size(s).between(16, 19) & _luhn(_digits(s["match"])),
        "phone": lambda s: size(s).between(8, 15),
    }[kind]


def _with_base(docs: DataFrame) -> DataFrame:
    """Adds, to rows with _text, _numeric and an array of spans _email, _ip, _card, _phone."""
    docs = docs.withColumn("_numeric", F.col("_text").rlike("[0-9]"))
    for kind in KINDS:
        hint = F.col("_text").contains("@") if kind == "email" else F.col("_numeric") & F.col("_text").rlike(HINT[kind])
        docs = docs.withColumn(f"_{kind}", F.filter(_found(F.col("_text"), BASE[kind], hint), _valid(kind)))
    return docs


FEATURES = (
    *(f"is_{k}" for k in ALL_KINDS), "length", "n_digits", "n_separators", "n_groups", "luhn", "bracket", "at_word", "dot_word", "colons", "longest_run",
    "glued_before", "glued_behind", *(f"cue_{c}" for c in _CUES), "small_parts", "n_letters", "n_distinct", "prefix", "tld",
)


def _features(text: Column, kind: str, s: Column) -> Column:
    """Format and context of a proposal, as a struct of doubles."""
    match = s["match"]
    digits = _digits(match)
    before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    behind = F.substring(text, s["end"] + 1, F.lit(1))
    values = {
        **{f"is_{k}": F.lit(float(k == kind)) for k in ALL_KINDS},
        "length": F.length(match), "n_digits": F.length(digits), "n_separators": F.length(F.regexp_replace(match, r"[^\x20./-]", "")),
        "n_groups": F.size(F.split(match, "[^0-9]+")), "luhn": F.when(F.length(digits).between(12, 19), _luhn(digits).cast("int")).otherwise(0),
        "bracket": match.rlike(r"[(\[{]").cast("int"), "at_word": match.rlike(r"(?i)[\[({]\s?at").cast("int"), "dot_word": match.rlike(r"(?i)dot|\.").cast("int"),
        "colons": F.length(F.regexp_replace(match, "[^:]", "")), "longest_run": F.array_max(F.transform(F.split(match, "[^0-9]+"), F.length)),
        "glued_before": before.rlike(r"[\p{L}\p{N}=#\"/_:-]$").cast("int"), "glued_behind": behind.rlike(r"[\p{L}\p{N}=#\"/_%-]").cast("int"),
        **{f"cue_{c}": before.rlike(p).cast("int") for c, p in _CUES.items()},
        "small_parts": F.size(F.filter(F.split(digits if kind != "ip" else match, "[^0-9]+"), lambda p: p.rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))),
        "n_letters": F.length(F.regexp_replace(match, "[^A-Za-z]", "")), "n_distinct": F.size(F.array_distinct(F.split(match, ""))),
        "prefix": match.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[a-z]-|AIza|eyJ)").cast("int"), "tld": match.rlike(r"(?i)(?:\.|dot[\])}]?\s?)(?:com|net|org|io|edu|gov|info|de|fr|es|it|uk|eu|ch|at|mx)$").cast("int"),
    }
    return F.struct(*(values[name].cast("double").alias(name) for name in FEATURES))


def _proposal(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _features(F.col("_text"), kind, s).alias("f"))


def _with_proposals(docs: DataFrame) -> DataFrame:
    """Adds _proposed: (kind, start, end, match, features) of what the generators find beside the base spans."""
    parts = []
    for kind, hint, pattern in PROPOSE:
        spans = _found(F.col("_text"), pattern, F.col("_text").rlike(hint) & (F.lit(kind in ("email", "secret")) | F.col("_numeric")))
        if kind == "phone":
            spans = F.filter(spans, lambda s: F.length(_digits(s["match"])).between(8, 15))
        docs = docs.withColumn(f"_more_{kind}", spans)
        parts.append(F.transform(F.col(f"_more_{kind}"), _proposal(kind)))
    base = F.concat(*(F.col(f"_{k}") for k in KINDS))
    free = F.filter(F.concat(*parts), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return docs.withColumn("_proposed", free).drop(*(f"_more_{k}" for k in ALL_KINDS))


# Trees.


@dataclass
class Boosted:
    """Trees as nested tuples (feature, limit, left, right) or leaf values; a calibrated probability threshold."""

    trees: list
    slope: float
    shift: float
    threshold: float

    def score(self, f: Column) -> Column:
        def node(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            name, limit, low, high = t
            return F.when(f[name] <= limit, node(low)).otherwise(node(high))

        total = reduce(lambda a, b: a + b, map(node, self.trees), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * self.slope + self.shift)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float):
    def leaf() -> float:
        return float(-rate * grad.sum() / (hess.sum() + 1.0))

    if depth == 0 or len(x) < 10:
        return leaf()
    whole, best = grad.sum() ** 2 / (hess.sum() + 1.0), (1e-6, None, None)
    for j in range(x.shape[1]):
        for limit in np.unique_values(x[:, j])[:-1]:
            low = x[:, j] <= limit
            g, h = grad[low].sum(), hess[low].sum()
            gain = g**2 / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - whole
            if gain > best[0]:
                best = (gain, j, float(limit))
    if best[1] is None:
        return leaf()
    low = x[:, best[1]] <= best[2]
    return (FEATURES[best[1]], best[2], _grow(x[low], grad[low], hess[low], depth - 1, rate), _grow(x[~low], grad[~low], hess[~low], depth - 1, rate))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    name, limit, low, high = tree
    return np.where(x[:, FEATURES.index(name)] <= limit, _apply(low, x), _apply(high, x))


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, precision: float = 0.98) -> Boosted:
    """Logistic boosting on the rows that are not held out; those give slope, shift and the threshold for ``precision``."""
    train_, hold = np.flatnonzero(~held), np.flatnonzero(held)
    total, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x[train_], (p - y)[train_], (p * (1 - p))[train_], depth, rate)
        trees.append(tree)
        total += _apply(tree, x)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt's two numbers by gradient descent
        p = 1 / (1 + np.exp(-(slope * total[hold] + shift)))
        slope -= 0.01 * ((p - y[hold]) * total[hold]).mean()
        shift -= 0.01 * (p - y[hold]).mean()
    p = 1 / (1 + np.exp(-(slope * total[hold] + shift)))
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[hold][order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(p[order]) < 0, True)  # a threshold lets all of equal scores through
    good = np.flatnonzero((right >= precision) & last)
    return Boosted(trees, float(slope), float(shift), float(p[order][good[-1]]) if len(good) else 1.1)


#: Synthetic texts: # is a random digit, ~ a random letter, ^ a random hexadecimal digit. Fixed values; the first list is personal data.
PERSONAL = (
    "you can reach me by phone (###) ###-#### after six", "call me: ###-###-#### any time", "tel. 0## ### ## ## at night", "mobile ### ### #### works best", "my cell is ###.###.#### thanks", "please phone ###-###-#### for help", "ring (0##) #### #### tonight",
    "Tél 0# ## ## ## ## le soir", "fax (0##) ### ## ##", "fax: ###.###.####", "whatsapp ###-###-#### me", "ring ### ### ### tonight", "Telefon: 0### ### ## ##", "móvil ### ## ## ##", "reach her at (###) ###-####", "fon 0### / ### ## ##", "call ###.###.#### and ask", "tel ### ### ####",
    "write to ~~~~~.~~~~ (at) ~~~~~~.com please", "mail me at ~~~~~## [at] ~~~~~~~ [dot] com ok", "write to ~~~~ (at) ~~~~.com", "mail ~~~ (at) ~~~.de now", "~~~~ [at] ~~~~~ [dot] org", "contact: ~~~ (at) ~~~~.io", "contact ~~~~ {at} ~~~~~~.org", "correo: ~~~~~ (at) ~~~~~.es", "~~~~~.~~~~~ [at] ~~~~~~.net is mine", "reach us (~~~~ (at) ~~~~~~~.io)",
    "reach ~~~~~_~~ (at) ~~~~ (dot) ~~~ today", "e-mail ~~~~~~ [@] ~~~~~.net", "courriel ~~~~~ (@) ~~~~~~ (dot) fr", "login from ####:0d##:####:00##:0a##:####:00##:#### at noon", "client ip ##[.]###[.]##[.]## seen", "host 1#(dot)##(dot)##(dot)1## was up", "from 1##[.]##[.]#[.]## again",
    "server ^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^ answered", "address ^^^^:^^^:^^^^:^:^:^:^^^^:^^ in the log", "blocked ##(dot)1##(dot)##(dot)## today", "my amex card 3782 822463 10005 is new", "card 378282246310005 paid", "pay by credit card 30569309025904", "visa 4222222222222 was charged", "karte 3714.496353.98431", "carte 3852 0000 0232 37",
    "debit 6304000000000000 ok", "tarjeta 3714 496353 98431", 'token = "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^" there', "api_key: ^^^^^^^^^^^^^^^^^^^^^^^^", "password='~#~#~~##~~#~~#~##'", "secret: ~~##~~~#~##~~#~~~#~~##~#", 'API-KEY="~#~~#~~#~~#~~#~~#~~#~~#~"', "bearer ~~##~#~~~##~#~~#~~#~#~~#~#~~",
    "use AKIA##~~#~##~~#~##~# for it", "ghp_~~#~~#~~#~~#~~#~~#~~#~~#~~#~~#~~#~~# works", "sk-~~##~~#~~#~#~~#~~#~~#~~#", "xoxb-##########-~~#~~#~~#~", "key AIza~~#~~#~~#~~#~~#~~#~~#~~#~~#~~#~~#~~", "eyJ~~#~~#~~#~~.eyJ~~#~~#~~#~~.~~#~~#~~#~~", "credential=~~#~#~~#~#~~##~~#", 'passwd: "~#~#~#~#~#~#~#~#"', "access_key=^^^^^^^^^^^^^^^^^^^^",
)
HARMLESS = (
    "order no. ###-##-#### shipped", "invoice ####-####-## is due", "date ##.##.20## was set", "part ###-###-#### in stock", "serial ###.###.####", "version ##.##.## came out", "the score was ## - ## - ## there", "ticket ### ### #### is open", "ref. ###-###-####",
    "isbn ###-#-##-######-#", "lot ####-##-## of wine", "sku ##-####-####", "see pages ##-##-## of it", "from 20##-##-## on", "ref ### ### #### closed", "time ##.##.##.## left", "id ###-###-####", "model ### ### ### sold", "code 0### ### ## ##", "invoice (##) ### ## ##",
    "rows ### ### ### of the table", "it (at) best was so", "the ticket ###-###-### is old", "model ####-####-####-#### sold", "order ################ done", "~~~~ ################ ~~~~", "~~~~~ ~~ #### #### #### #### ~~~", "~~~ ###############. ~~~~ ~~", "~~~~ ##-####-###### ~~~", "card no ############## void", "~~~~~ ###-###-#### ~~~~", "~~~ ### ### ### ~~~", "code ### ### #### expired", "~~~~ [at] ~~~~ and more",
    "look (at) this.now please", "~~~~~ (at) ~~~~.~~~~~ ~~~~", "come (at) ~~~~.and go", "we met (at) ~~~~~~. ~~~ was there", "meet {at} ~~~~ tomorrow", "~~~~~~ ~~~ #############. ~~~~~~", "serial ################# of it", "part no ################", "we had ### ### ### of them", "~~~~ ##.##.####.## ~~~", "~~~~ #### #### #### ####, ~~~ ~~~~", "~~~~~ ################ ~~~~~ ~~~", "~~~ ###################. ~~~",
    "~~~~ ##.###.##.### ~~~~", "~~~ ###.### ## ~~~", "~~~~ ## ### ## ### ~~~", "mac ^^:^^:^^:^^:^^:^^:^^:^^ of it", "~~~ ##:##:##:##:##:##:##:## ~~~", "fingerprint ^^:^^:^^:^^:^^:^^:^^:^^ ok", "sum ### ### ### of all", "~~~~ ##/##/####/## ~~", "~~~~ ####.####.## ~~~", "took ##.##.##.## of it",
    "~~~ ##-##-##-## ~~~", "~~~ #### ## ## ~~~~~", "~~~~~ ###.##.#### ~~", "~~ ^^:##:^^:##:^^:##:^^:## ~~~", "we count ## ### ### so far", "~~~~ ### ## ### ~~~",
    "hash ##:##:##:##:##:##:##:## of it", "at ##:##:## on day", "a token of thanks-to-everyone-here", "the secret well-known-everywhere is out", "password requirements-and-other-rules apply", "token authentication-and-authorization works", "the api key documentation_is_over_there", "secret: internationalization", "password: changed-every-month-or-so", "token = configuration_of_everything", "bearer of-all-the-bad-news-today", "their token appreciation-of-the-work", "sk-learning-by-doing-every-day", "credential management-and-storage rules",
)


def _synthetic(spark: SparkSession, n: int) -> DataFrame:
    """Texts with a label and the number of their template, made by hashing row numbers."""
    rows = [(t, 1) for t in PERSONAL] + [(t, 0) for t in HARMLESS]
    templates = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(y).alias("y"), F.lit(k).alias("k")) for k, (t, y) in enumerate(rows)))
    pick = F.get(templates, F.pmod(F.xxhash64("id"), F.lit(len(rows))).cast("int"))
    letters, hexadecimal = (F.split(F.lit(x), "") for x in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"))

    def fill(c: Column, i: Column) -> Column:
        h = F.xxhash64(F.col("id"), i, F.lit(7))
        some = lambda of, m: F.get(of, F.pmod(h, F.lit(m)).cast("int"))
        return F.when(c == "#", F.pmod(h, F.lit(10)).cast("string")).when(c == "~", some(letters, 26)).when(c == "^", some(hexadecimal, 16)).otherwise(c)

    picked = spark.range(0, n, 1, 4).select("id", pick.alias("pick"))
    return picked.select("id", F.array_join(F.transform(F.split("pick.t", ""), fill), "").alias("_text"), F.col("pick.y").alias("y"), F.col("pick.k").alias("template"))


def _proposals(spark: SparkSession, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and templates of the proposals in ``n`` synthetic texts."""
    marked = _with_proposals(_with_base(_synthetic(spark, n))).select("id", "y", "template", F.explode("_proposed").alias("p"))
    rows = sorted(marked.select("id", "y", "template", "p.start", *(F.col(f"p.f.{f}").alias(f) for f in FEATURES)).collect())
    return np.array([r[4:] for r in rows], dtype=float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows], dtype=int)


@cache
def _trained(n: int) -> Boosted:
    return boost(*(lambda x, y, template: (x, y, template % 4 == 1))(*_proposals(SparkSession.getActiveSession(), n)))


def train(spark: SparkSession, n: int = 4000, **options) -> Boosted:
    """Fit on the proposals of ``n`` synthetic texts (a fixed, documented number); every fourth template is held out. Fitted once a session."""
    if not options:
        return _trained(n)
    x, y, template = _proposals(spark, n)
    return boost(x, y, template % 4 == 1, **options)


_RESULTS = (*(f"n_{k}" for k in ALL_KINDS), "n_spans", "base_sha256", "spans", "secret_spans", "found")


def _marked(docs: DataFrame, model: Boosted) -> DataFrame:
    """_row (all columns), _base and _found (arrays of kind, start, end), and the base spans by kind."""
    marked = _with_proposals(_with_base(docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))))
    scored = F.transform("_proposed", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), model.score(c["f"]).alias("score")))
    marked = marked.withColumn("_scored", F.when(F.size("_proposed") > 0, F.filter(scored, lambda c: c["score"] >= model.threshold)))
    rank = lambda c: F.struct(-c["score"], c["start"], c["kind"])
    beaten = lambda c: F.exists("_scored", lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"]) & (rank(d) < rank(c)))
    marked = marked.withColumn("_added", F.coalesce(F.filter("_scored", lambda c: ~beaten(c)), F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")))
    plain = lambda kind: F.transform(F.col(f"_{kind}"), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = lambda kind: F.transform(F.filter("_added", lambda c: c["kind"] == kind), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    both = [F.array_sort(F.concat(plain(k), added(k))) for k in KINDS] + [F.array_sort(added("secret"))]
    return marked.withColumn("_base", F.concat(*map(plain, KINDS))).withColumn("_all", F.concat(*both))


def find(docs: DataFrame, model: Boosted | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, n_email, n_ip, n_card, n_phone (base spans), n_secret, n_spans, base_sha256, spans, secret_spans, found.

    spans are those of the four kinds, base and added, n_spans their number; secrets have a column of their own. found is an array of
    (kind, start, end) of both, by kind as listed (secrets last), then start. A kept column that is named like a result is left out.
    """
    marked = _marked(docs, model or train(docs.sparkSession))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kept = [F.col("_row")[c].alias(c) for c in dict.fromkeys(keep) if c not in _RESULTS]
    personal, secrets = F.filter("_all", lambda s: s["kind"] != "secret"), F.filter("_all", lambda s: s["kind"] == "secret")
    return marked.select(
        *kept, *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.size(secrets).cast("long").alias("n_secret"), F.size(personal).cast("long").alias("n_spans"),
        F.sha2(joined("_base"), 256).alias("base_sha256"), joined(personal).alias("spans"), joined(secrets).alias("secret_spans"), F.col("_all").alias("found"),
    )


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """The same columns and rows; in ``text`` every span becomes its kind in brackets.

    Spans that overlap become one, named after the one that begins first; a null text stays null.
    """
    marked = _marked(docs, model or train(docs.sparkSession))
    order = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.array(F.substring("_text", acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(order, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("_text", acc["at"] + 1, F.length("_text"))))
    text = F.when(F.size("_all") > 0, whole).otherwise(F.col("_row")["text"])
    return marked.select(*(text.alias("text") if n == "text" else F.col("_row")[n].alias(n) for n in docs.columns))
