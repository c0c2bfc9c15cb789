"""Personal data: rule spans, plus candidates that gradient-boosted trees accept. DataFrame functions only.

Rule spans are the leftmost non-overlapping matches of four patterns that pass their test (address parts, digits,
Luhn). Their patterns are written so that no match is retried from the middle of a run: possessive, and starting where
a run starts or where the last match ended, which finds the same matches in linear time.

Three high-recall generators propose overlapping candidate spans: addresses, also written out ("at", "(dot)"); digit
groups of 8 to 32 characters; strings of 16 to 128 characters as keys have, for the fifth kind, secret, which has no rule.
A candidate has format features (digits, groups, separators, checks) and context features (neighbouring characters, a
cue word before it), each with few values.

What the trees learn from is not the rules' own verdict alone. The corpus gives its candidates: of the kind of the rule
span that they overlap, of no kind where they overlap none and follow no cue word (those that follow one teach nothing, as
rules may have missed them). Each rule span gives made-up rows besides, in its own context: forms that the rules miss, of
its kind (written-out, bare, dotted, defanged, regrouped; keys made from its digest after a secret's cue), and noise of
no kind (dates, amounts, broken check digits, prose around "at", digests without a cue). All are counted into cells of
equal features. For each kind boosted regression trees fit its share of the cells of its generator under the logistic
loss, on half of the rows (by hash of doc_id); on the others the margins are calibrated (Platt), and a candidate of a
probability of at least CHANCE is taken, by its likeliest kind, if the held-out rows from there on are right to a share
of PRECISION at least and it touches no rule span.

The driver gets one row for each cell, at most the product of the features' values. Defined cases: null text is empty;
without rule spans nothing is learned or added; rows of null or equal doc_id are handled alike; repeated rows give equal
values; ties between kinds go to the first listed; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_KEY = "[A-Za-z0-9+/_=-]"
#: What follows the local part of an address: the host's first name, and each further one.
_AT = rf"(?:@|\(at\)|\[at\]|(?<= )at(?= )) ?{_HOST}{{1,64}}+"
_DOT = rf"(?: ?(?:\.|\(dot\)|\[dot\]|(?<= )dot(?= )) ?{_HOST}{{2,64}}+)"
GENERATORS = (
    rf"{_LOCAL}{{1,64}}+ ?{_AT}{_DOT}++",
    r"\+?\(?[0-9](?:[0-9 ().-]|\[\.\]){6,30}[0-9]",
    rf"(?<!{_KEY}){_KEY}{{16,128}}+(?!{_KEY})",
)
#: Each is a part of what its generator matches, so that no candidate is left out.
GENERATOR_GUARDS = (_AT + _DOT, r"[0-9][0-9 ().\[\]-]{6}", rf"{_KEY}{{16}}")
#: Generator of each kind's candidates.
GENERATOR_OF = (0, 1, 1, 1, 2)
CUES = r"(?i)\b(?:tel|phone|call|fax|mobile|mail|e-mail|contact|write|card|account|visa|ip|host|address|reach)\b"
SECRET_CUES = r"(?i)(?:token|secret|passw|api.?key|private.?key|\bkey\b|bearer|credential)"
FEATURES = ("generator", "digits", "groups", "separators", "check", "before", "after", "cue")
PRECISION, CHANCE, TREES, DEPTH, RATE = 0.95, 0.9, 16, 3, 0.5
SPAN = "array<struct<k:int,s:int,e:int>>"
CANDIDATE = "array<struct<s:int,e:int,generator:int,digits:int,groups:int,separators:int,check:int,before:int,after:int,cue:int>>"


def matches(text: Column, pattern: str, guard: str) -> Column:
    """Array of (s, e, m): code-point start, end and text of each match, from the gaps between matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<s:int,e:int,m:string>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(text.rlike(guard), F.aggregate(pairs, start, add, lambda acc: acc["out"])).otherwise(F.expr("CAST(array() AS array<struct<s:int,e:int,m:string>>)"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), weigh), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Rule spans (k, s, e), by kind and start."""

    def of(k: int, kind: str) -> Column:
        valid = F.filter(matches(text, PATTERNS[kind], GUARDS[kind]), lambda x: passes(kind, x["m"]))
        return F.transform(valid, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    found = [of(k, kind) for k, kind in enumerate(PATTERNS)]
    return F.concat(*found).cast(SPAN)


def _bucket(x: Column, cuts: tuple[int, ...]) -> Column:
    out = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        out = F.when(x < cut, i).otherwise(out)
    return out


def _class(c: Column) -> Column:
    """0 edge, 1 white space, 2 letter or underscore, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[\p{L}_]"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _format(g: int, m: Column) -> tuple[Column, Column, Column, Column]:
    """Format features of a candidate's text: digits, groups, separators, check."""
    if g == 0:
        ending = F.length(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1))
        at = F.when(m.contains("@"), 0).when(m.rlike(r"[(\[]at[)\]]"), 1).otherwise(2)
        dot = F.when(m.rlike(r"[(\[]dot[)\]]"), 1).when(m.contains(" dot "), 2).when(m.rlike(r"\. |\s\."), 3).otherwise(0)
        return _bucket(ending, (3, 4, 5, 7)), at, dot, F.lit(0)
    if g == 1:
        number, parts = digits(m), F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
        marks = F.when(m.contains("[.]"), 1).when(m.contains("."), 2).otherwise(0) + F.when(m.rlike("[ ()-]"), 3).otherwise(0) + F.when(m.startswith("+"), 6).otherwise(0)
        address = (F.size(parts) == 4) & F.forall(parts, lambda x: (F.length(x) <= 3) & (x.cast("int") <= 255))
        return _bucket(F.length(number), (8, 9, 10, 11, 12, 13, 16, 17, 20)), _bucket(F.size(parts), (2, 3, 4, 5, 6)), marks, luhn(number).cast("int") + F.when(address, 2).otherwise(0)
    letters = F.when(m.rlike("[A-Za-z]"), 1).otherwise(0)
    mixed = F.when(m.rlike("^[0-9a-f]+$"), 2).when(m.rlike("[0-9]"), 1).otherwise(0) * letters
    return _bucket(F.length(m), (20, 24, 32, 40, 64)), mixed, F.when(m.rlike("[+/=]"), 2).when(m.rlike("[_-]"), 1).otherwise(0), _bucket(F.length(digits(m)) * 10 / F.length(m), (1, 2, 10))


def _described(g: int, m: Column, before: Column, after: Column, cue: Column) -> list[Column]:
    columns = (F.lit(g), *_format(g, m), before, after, cue)
    return [c.cast("int").alias(f) for f, c in zip(FEATURES, columns)]


def _context(text: Column, s: Column, e: Column) -> tuple[Column, Column, Column]:
    """Classes of the neighbouring characters, and the cue before: 2 of a secret, 1 of another kind, 0 none."""
    lead = F.substring(text, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24)))
    cue = F.when(lead.rlike(SECRET_CUES), 2).when(lead.rlike(CUES), 1).otherwise(0)
    return _class(F.when(s > 0, F.substring(text, s, F.lit(1))).otherwise("")), _class(F.substring(text, e + 1, F.lit(1))), cue


def candidates(text: Column) -> Column:
    """Candidate spans with their features."""

    def described(g: int):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), *_described(g, x["m"], *_context(text, x["s"], x["e"])))

    return F.concat(*(F.transform(matches(text, GENERATORS[g], GENERATOR_GUARDS[g]), described(g)) for g in range(len(GENERATORS)))).cast(CANDIDATE)


#: Context of a character class for made-up rows: white space, a quote or another mark.
_SPACE, _QUOTE = 1, 4


def made_up(base: Column, text: Column) -> Column:
    """Rows (kind or -1, generator, m, before, after, cue) made from each rule span: missed forms of its kind, keys of its
    digest, and noise. Those without a context of their own have the span's."""

    def seen(x: Column) -> Column:
        m = F.substring(text, x["s"] + 1, x["e"] - x["s"])
        before, after, cue = _context(text, x["s"], x["e"])
        return F.struct(x["k"].alias("k"), m.alias("m"), digits(m).alias("number"), F.sha1(m).alias("digest"), F.md5(m).alias("short"), F.translate(F.sha1(m), "abcdef", "123456").alias("some"), before.alias("before"), after.alias("after"), F.least(cue, F.lit(1)).alias("cue"))

    def rows(x: Column) -> Column:
        m, number, digest, short = x["m"], x["number"], x["digest"], x["short"]
        plain = lambda at, n: F.substring(F.concat(number, x["some"]), at, n)
        grouped = lambda mark, *cuts: F.concat_ws(mark, *(plain(at, n) for at, n in cuts))
        spelled = lambda at, dot: F.replace(F.replace(m, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))
        tail = [F.substring(number, -10, 3), F.substring(number, -7, 3), F.substring(number, -4, 4)]

        def row(g: int, form: Column, before: Column | int = x["before"], after: Column | int = x["after"], cue: Column | int = x["cue"]) -> Column:
            context = [(F.lit(c) if isinstance(c, int) else c).cast("int") for c in (before, after, cue)]
            return F.struct(F.lit(g).alias("generator"), form.alias("m"), *(c.alias(n) for c, n in zip(context, FEATURES[-3:])))

        spellings = ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("(at)", "."), (" at ", "."), (" @ ", "."))
        missed = [
            [row(0, spelled(at, dot)) for at, dot in spellings],
            [row(1, F.replace(m, F.lit("."), F.lit("[.]"))), row(1, m)],
            [row(1, number), *(row(1, F.concat_ws(mark, *(F.substring(number, at, 4) for at in (1, 5, 9)), F.substring(number, 13, 7))) for mark in (".", " ", "-"))],
            [row(1, F.regexp_replace(m, r"^\+", "")), *(row(1, F.concat_ws(mark, *tail)) for mark in (".", "-", " ")), row(1, F.concat(F.lit("("), tail[0], F.lit(") "), tail[1], F.lit("-"), tail[2]))],
        ]
        keys = [row(2, form, before, after, 2) for form in (digest, short, F.base64(F.unhex(F.sha2(m, 256))), F.concat(F.lit("sk_"), short)) for before, after in ((_QUOTE, _QUOTE), (_SPACE, _SPACE), (_SPACE, _QUOTE))]
        broken = F.concat(F.substring(number, 1, 15), F.pmod(F.substring(number, 16, 1).cast("int") + 1, F.lit(10)).cast("string"))
        dates = [F.concat(F.lit("20"), grouped("-", (1, 2), (3, 2), (5, 2))), F.concat(grouped(".", (1, 2), (3, 2)), F.lit(".20"), plain(5, 2))]
        amounts = [grouped(".", (1, 1), (2, 3), (5, 3)), grouped(".", (1, 3), (4, 3), (7, 3)), grouped(" ", (1, 2), (3, 2), (5, 2), (7, 2)), grouped("-", (1, 4), (5, 4)), grouped(".", (1, 1), (2, 1), (3, 1), (4, 4))]
        counts = [*(plain(1, n) for n in (8, 9, 10, 11, 12, 13, 14)), F.when(F.length(number) >= 16, broken).otherwise(plain(1, 18))]
        prose = F.concat(F.lit("met at "), F.substring(digest, 1, 6), F.lit(". "), F.substring(digest, 7, 4))
        strings = [(digest, 0), (short, 1), (F.translate(digest, "0123456789", "ghijklmnop"), 2), (plain(1, 16), 2), (plain(1, 20), 0), (F.lit("well-known-long-name"), 0)]
        none = [*(row(1, n) for n in [*dates, *amounts, *counts]), row(0, prose), *(row(2, n, before, _SPACE, cue) for n, cue in strings for before in (_SPACE, _QUOTE))]
        of = lambda k, made: F.transform(F.array(*made), lambda r: F.struct(k.alias("kind"), *(r[f].alias(f) for f in ("generator", "m", *FEATURES[-3:]))))
        own = F.when(x["k"] == 0, F.array(*missed[0]))
        for k in (1, 2, 3):
            own = own.when(x["k"] == k, F.array(*missed[k]))
        own = F.transform(own, lambda r: F.struct(x["k"].alias("kind"), *(r[f].alias(f) for f in ("generator", "m", *FEATURES[-3:]))))
        return F.concat(own, of(F.lit(4), keys), of(F.lit(-1), none))

    return F.flatten(F.transform(F.transform(base, seen), rows))


def _overlaps(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))


class Trees:
    """Boosted regression trees over cells; a tree is (feature, cut, below, above) or a leaf value."""

    def __init__(self, x: np.ndarray, right: np.ndarray, wrong: np.ndarray):
        total = right + wrong
        p = min(0.999, max(0.001, right.sum() / max(1.0, total.sum())))
        self.bias, self.trees = math.log(p / (1 - p)), []
        margin = np.full(len(x), self.bias)
        for _ in range(TREES if len(x) else 0):
            chance = 1 / (1 + np.exp(-margin))
            self.trees.append(self._grow(x, right - total * chance, total * chance * (1 - chance), np.arange(len(x)), DEPTH))
            margin += self._value(self.trees[-1], x)

    def _grow(self, x: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int):
        gain = lambda r: slope[r].sum() ** 2 / (curve[r].sum() + 1.0)
        best = None
        for f in range(x.shape[1]) if depth else ():
            for cut in np.unique(x[rows, f])[1:].tolist():
                low = x[rows, f] < cut
                worth = gain(rows[low]) + gain(rows[~low]) - gain(rows)
                if worth > 1e-6 and (best is None or worth > best[0] + 1e-12):
                    best = worth, f, int(cut), rows[low], rows[~low]
        if best is None:
            return float(RATE * slope[rows].sum() / (curve[rows].sum() + 1.0))
        _, f, cut, low, high = best
        return f, cut, self._grow(x, slope, curve, low, depth - 1), self._grow(x, slope, curve, high, depth - 1)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] < cut, self._value(low, x), self._value(high, x))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, c: Column) -> Column:
        """The margin of a candidate as an expression."""

        def expression(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, low, high = tree
            return F.when(c[FEATURES[f]] < cut, expression(low)).otherwise(expression(high))

        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + expression(tree)
        return out


def platt(margin: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[float, float]:
    """a and b of the probability 1 / (1 + exp(-(a * margin + b))), by Newton steps with a small ridge."""
    x, total = np.column_stack([margin, np.ones(len(margin))]), right + wrong
    w = np.array([1.0, 0.0])
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (right - total * chance) - 1e-3 * (w - [1.0, 0.0])
        curve = (x * (total * chance * (1 - chance))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(cells: list[tuple], precision: float = PRECISION, chance: float = CHANCE) -> tuple[Trees, tuple[float, float], float | None]:
    """Trees, calibration and threshold from cells (features..., half, right, wrong). The threshold is the lowest margin of a
    calibrated probability of at least chance from which on the held-out rows are right to a share of precision at least;
    None where there is none."""
    rows = np.array(sorted(cells), np.float64).reshape(-1, len(FEATURES) + 3)
    x, half, right, wrong = rows[:, : len(FEATURES)], rows[:, -3], rows[:, -2], rows[:, -1]
    trees = Trees(x[half == 0], right[half == 0], wrong[half == 0])
    margin, right, wrong = np.round(trees.margins(x[half == 1]), 9), right[half == 1], wrong[half == 1]
    a, b = platt(margin, right, wrong) if right.sum() and len(margin) else (1.0, 0.0)
    threshold = None
    hit = miss = 0.0
    for m in np.unique(margin)[::-1].tolist():
        hit, miss = hit + right[margin == m].sum(), miss + wrong[margin == m].sum()
        if a <= 0 or a * m + b < math.log(chance / (1 - chance)) or hit / max(1.0, hit + miss) < precision:
            break
        threshold = m
    return trees, (a, b), threshold


def learned(found: DataFrame) -> list[tuple[Trees, tuple[float, float], float | None]]:
    """A model for each kind from the candidates, rule spans and made-up rows of found."""
    half = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(2)).alias("half")
    over = lambda base, c: F.filter(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    kind = F.coalesce(F.try_element_at(over(F.col("_base"), F.col("c")), F.lit(1))["k"], F.lit(-1))
    real = found.where(F.size("_candidates") > 0).select(half, "_base", F.explode("_candidates").alias("c")).select("half", kind.alias("kind"), *(F.col(f"c.{f}").alias(f) for f in FEATURES))
    real = real.where("kind >= 0 OR cue = 0")  # without a rule span but after a cue word: of unknown kind
    made = found.where(F.size("_base") > 0).select(half, F.explode("_made").alias("c")).select("half", "c.*")
    formats = [_format(g, F.col("m")) for g in range(len(GENERATORS))]
    which = lambda i: F.when(F.col("generator") == 0, formats[0][i]).when(F.col("generator") == 1, formats[1][i]).otherwise(formats[2][i]).cast("int")
    made = made.select("half", "kind", "generator", *(which(i).alias(f) for i, f in enumerate(FEATURES[1:-3])), *FEATURES[-3:])
    cells = real.unionByName(made).groupBy(*FEATURES, "half", "kind").agg(F.count(F.lit(1)).alias("n")).collect()
    models = []
    for k in range(len(KINDS)):
        tally: dict[tuple, list[int]] = {}
        for *features, part, own, n in map(tuple, cells):
            if features[0] == GENERATOR_OF[k]:
                tally.setdefault((*features, part), [0, 0])[0 if own == k else 1] += n
        models.append(fit([(*key, *n) for key, n in tally.items()]))
    return models


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with base (rule spans) and spans (rule and added spans), both by kind and start."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(keep)]
    found = docs.select(*own, "doc_id", F.col("text").alias("_text"), base_spans(text).alias("_base"), candidates(text).alias("_candidates"))
    found = scratch.keep(found.withColumn("_made", made_up(F.col("_base"), F.coalesce("_text", F.lit("")))).drop("_text"), "found")
    models = learned(found)
    base, back = F.col("_base"), [F.col(f"_own_{i}").alias(c) for i, c in enumerate(keep)]
    use = [(k, *model) for k, model in enumerate(models) if model[2] is not None]
    if not use:
        return found.select(*back, base.alias("base"), base.alias("spans"))

    def named(c: Column) -> Column:
        """The candidate as a span of its likeliest accepted kind, k null if there is none."""
        options = []
        for k, trees, (a, b), threshold in use:
            margin = F.round(trees.column(c), 9)
            mine = (c["generator"] == GENERATOR_OF[k]) & (margin >= threshold)
            options.append(F.when(mine, F.struct((margin * a + b).alias("p"), F.lit(-k).alias("k"))))
        best = options[0] if len(options) == 1 else F.greatest(*options)
        return F.struct((-best["k"]).alias("k"), c["s"].alias("s"), c["e"].alias("e"))

    added = F.filter(F.transform(F.filter("_candidates", lambda c: ~_overlaps(base, c)), named), lambda x: x["k"].isNotNull())
    return found.select(*back, base.alias("base"), F.array_sort(F.concat(base, added.cast(SPAN))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans by the kind of the first one."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

    def add(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.element_at(kinds, x["k"] + 1))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(by_start, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text)
