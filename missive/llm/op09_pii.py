"""Personal data by boosted trees over candidate spans; DataFrame functions only.

Every kind has a base pattern with a check (``email``, ``ip``, ``card``, ``phone``); base spans always stay.
High-recall generators then propose further, overlapping spans: addresses in disguise, numbers
without a country code, card numbers and addresses of hosts in other notations.  Features of
a candidate's format and of the text around it go through gradient-boosted trees, their sum
through a calibration curve, and candidates above their kind's threshold that overlap no
base span and no better candidate are added.

Everything about a document is computed in its row: nothing is shuffled.  The trees are
fitted in the driver on a fixed set of made-up sentences (``EXAMPLES`` of them), whose
candidates and features come from the same expressions; the fitted trees are ``CASE``
expressions.  Places are code points.

Patterns are written so that they need no backtracking over long runs.  A match is found by
marking matches in the text and summing lengths, so ``\\x01`` in a text is read as ``\\x02``.  Every
step over a text's matches goes through them once, in order of place, in blocks (``walk``), so
that a text with very many of them costs in proportion to their number.

Secrets (quoted values after words such as ``token`` or ``api key``) are listed apart, as they are none of
the four kinds.

Edge cases: a null text is empty and has no spans; repeated rows and ids are rows of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MARK, OTHER = "\x01", "\x02"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its base pattern to be tried.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Generators: kind, pattern, hint.
MORE = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}|(?<= )at(?= )) ?[a-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= )|\.) ?[a-z0-9-]{2,63}+){1,4}+", r"(?i)[\[({ ]at[\])} ]"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){5,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("ip", r"(?<![0-9.\]])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])", r"[0-9][\[(]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:(?: - |[./_\x20-])[0-9]{4}){3}(?![0-9])", r"[0-9]{4}[./_\x20-]"),
    ("card", r"(?<![0-9])3[0-9]{3}(?: - |[./_\x20-])[0-9]{6}(?: - |[./_\x20-])[0-9]{5}(?![0-9])", r"3[0-9]{3}[./_\x20-]"),
    ("phone", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,5}\)[\x20-]?)?[0-9]{2,5}(?:[\x20./-][0-9]{2,4}){1,4}(?![0-9A-Za-z])", r"[0-9][\x20./-][0-9]"),
    ("phone", r"(?<![0-9A-Za-z+.-])00[1-9][0-9\x20-]{7,14}[0-9](?![0-9A-Za-z])", r"00[1-9]"),
)
#: A value after the name of a secret and a sign, without the quotes around it.
SECRET = r"(?i)(?<=(?:token|secret|password|passwd|apikey|api_key|api-key|api key|access key|access_key|private key)[\x20]{0,2}[=:][\x20]{0,2}['\"]?)[A-Za-z0-9+/=_.~-]{16,256}+"
SECRET_HINT = r"[=:](?<=(?i:token|secret|password|passwd|key)[\x20]{0,2}[=:])"  # the sign first: few characters are one
SPAN = "array<struct<start:int,end:int,s:string,left:string,right:string>>"
#: Characters kept of what stands before and after a match, and items and characters that ``walk`` and ``redact`` take at a time.
LEFT, RIGHT, BLOCK, SEGMENT = 32, 3, 256, 4096
#: Made-up sentences for fitting, and how the trees are grown.
EXAMPLES, ROUNDS, DEPTH, RATE, PRECISION = 1600, 24, 3, 0.3, 0.97
WORDS = {
    "email": r"(mail|contact|write|reach|courriel|correo|kontakt|schreib)",
    "ip": r"(\bip\b|address|host|server|ping|adress|direcci)",
    "card": r"(card|visa|amex|master|credit|debit|pay|karte|carte|tarjeta)",
    "phone": r"(phone|call|\btel|mobile|\bcell|fax|whatsapp|\bsms|anruf|appel|llam)",
}
NUMBER = r"(order|invoice|isbn|\bref|version|serial|part no|article|page|pages|\bid\b|score|year|lot|vol|from|between|date|on the)[^a-z]{0,4}$"


def walk(items: Column, state: Column, out_type: str, step) -> Column:
    """Go through an array once: ``step(state, item)`` gives the next state and an array of what is put
    out.  Gives ``state``, the last one, and ``out``, all that was put out.

    An array that grows by one costs its length each time, so items are taken in blocks, each
    with an array of its own, and these are laid end to end at the last."""
    none = F.array().cast(f"array<{out_type}>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / F.lit(BLOCK)).cast("int")),
        lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)),
    )

    def item(acc: Column, x: Column) -> Column:
        new, put = step(acc["state"], x)
        return F.struct(new.alias("state"), F.when(F.size(put) > 0, F.concat(acc["out"], put)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), item)
        return F.aggregate(F.array(got), acc, lambda a, g: F.struct(g["state"].alias("state"), F.concat(a["out"], F.array(g["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
    return F.aggregate(blocks, start, block, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))


def spans(text: Column, pattern: str, hint: str) -> Column:
    """The leftmost non-overlapping matches as ``SPAN``, with what stands before (up to ``LEFT``
    characters) and after (up to ``RIGHT``, none if another match follows at once)."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    none = F.array().cast(SPAN)
    open_span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("s"), F.lit("").alias("left"), F.lit("").alias("right"))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.lit("").alias("before"), F.lit(False).alias("any"), open_span.alias("open"))

    def step(acc: Column, part: Column) -> tuple[Column, Column]:
        end = acc["at"] + F.length(part)
        found = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("s"), acc["before"].alias("left"), F.lit("").alias("right"))
        before = F.right(F.concat(acc["before"], part), F.lit(LEFT))
        last = acc["open"]
        whole = F.struct(*(last[c].alias(c) for c in ("start", "end", "s", "left")), F.left(part, F.lit(RIGHT)).alias("right"))
        put = F.when(acc["any"] & ~acc["hit"], F.array(whole)).otherwise(none)
        new = F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), before.alias("before"), acc["hit"].alias("any"), F.when(acc["hit"], found).otherwise(last).alias("open"))
        return new, put

    return F.when(text.rlike(hint), walk(parts, start, SPAN[6:-1], step)["out"]).otherwise(none)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        n = F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))
        twice = 2 * n
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), value)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(s: Column) -> Column:
    """Whether all four parts are at most 255."""
    return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return small_parts(s)
    n = F.length(digits(s))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(s))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def with_base(rows: DataFrame) -> DataFrame:
    """``rows(text)`` and an array of base spans for each kind."""
    text = F.translate("text", MARK, OTHER)
    rows = rows.withColumn("text", F.coalesce(text, F.lit("")))

    def kept(kind: str) -> Column:
        return F.filter(spans(F.col("text"), BASE[kind], HINT[kind]), lambda x: valid(kind, x["s"]))

    return rows.withColumns({k: kept(k) for k in KINDS})


FEATURES = ("kind", "digits", "letters", "marks", "luhn", "varied", "named", "numbered", "glued_left", "glued_right", "brackets", "groups", "mixed", "year")


def described(kind: int, x: Column) -> Column:
    """A candidate with its features."""
    s, number = x["s"], digits(x["s"])
    left, right = F.lower(x["left"]), x["right"]
    n_digits, n_letters = F.length(number), F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    flag = lambda c: c.cast("double")
    values = {
        "kind": F.lit(float(kind)),
        "digits": n_digits,
        "letters": n_letters,
        "marks": F.length(s) - n_digits - n_letters,
        "luhn": flag(luhn(number)),
        "varied": F.size(F.array_distinct(F.split(number, ""))),
        "named": flag(left.rlike(WORDS[KINDS[kind]])),
        "numbered": flag(left.rlike(NUMBER)),
        "glued_left": flag(left.rlike(r"[a-z0-9./:_-]$")),
        "glued_right": flag(right.rlike(r"^[A-Za-z0-9/:_%-]")),
        "brackets": flag(s.rlike(r"[\[({]")),
        "groups": F.size(F.split(s, r"[^0-9A-Za-z]+")),
        "mixed": F.size(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"[\x20./_-]"), F.lit(0)), lambda c: c))),
        "year": flag(s.rlike(r"(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])")),
    }
    return F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        F.array(*(values[f].cast("double") for f in FEATURES)).alias("f"),
    )


def candidates(text: Column) -> Column:
    def proposed(kind: int, pattern: str, hint: str) -> Column:
        return F.transform(spans(text, pattern, hint), lambda x: described(kind, x))

    return F.concat(*(proposed(KINDS.index(k), p, h) for k, p, h in MORE))


PROPOSED = "struct<start:int,end:int,kind:int,p:double>"


def free_of(base: Column, proposed: Column) -> Column:
    """``proposed`` (``PROPOSED``) that overlap none of ``base`` (``start, end``), in order of their ends.

    Both go by in one order: ends of proposals, and starts of base spans after ends at the same
    place.  The largest end of the base spans that started before a proposal ended tells."""
    blank = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("kind"), F.lit(0.0).alias("p"))
    ends = F.transform(proposed, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("what"), F.lit(0).alias("reach"), c.cast(PROPOSED).alias("c")))
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("what"), b["end"].alias("reach"), blank.cast(PROPOSED).alias("c")))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        free = (x["what"] == 0) & (reach <= x["c"]["start"])
        return F.greatest(reach, x["reach"]), F.when(free, F.array(x["c"])).otherwise(F.array().cast(f"array<{PROPOSED}>"))

    found = walk(F.array_sort(F.concat(ends, starts)), F.lit(0), PROPOSED, step)["out"]
    return F.when(F.size(proposed) > 0, found).otherwise(F.array().cast(f"array<{PROPOSED}>"))


def best_of(proposed: Column) -> Column:
    """Of each run of proposals that overlap one after the other the most probable, of equals the longest,
    then the first.  Sorted by place, a run ends where a proposal begins past all ends before it."""
    none = F.array().cast(f"array<{PROPOSED}>")
    blank = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("kind"), F.lit(-1.0).alias("p")).cast(PROPOSED)
    rank = lambda c: F.struct(c["p"], c["end"] - c["start"], -c["start"], -c["kind"])

    def step(acc: Column, c: Column) -> tuple[Column, Column]:
        new = c["start"] >= acc["reach"]
        better = new | (rank(c) > rank(acc["best"]))
        state = F.struct(F.greatest(acc["reach"], c["end"]).alias("reach"), F.when(better, c).otherwise(acc["best"]).cast(PROPOSED).alias("best"))
        return state, F.when(new & (acc["best"]["end"] >= 0), F.array(acc["best"])).otherwise(none)

    # Nothing overlaps the last item, which closes the last run.
    last = F.struct(F.lit(2**31 - 2).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit(0).alias("kind"), F.lit(0.0).alias("p")).cast(PROPOSED)
    items = F.concat(F.array_sort(proposed), F.array(last))
    start = F.struct(F.lit(0).alias("reach"), blank.alias("best"))
    return F.when(F.size(proposed) > 0, walk(items, start, PROPOSED, step)["out"]).otherwise(none)


#: What candidates look like: ``~`` a word, ``#`` a digit, ``N`` one but 0, ``x`` a hexadecimal digit.
GOOD = [
    ("email", "~.~ (at) ~.com"), ("email", "~ [at] ~ [dot] org"), ("email", "~## at ~ dot com"), ("email", "~{at}~.net"),
    ("ip", "2001:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx:xxxx"), ("ip", "N#[.]N#[.]N[.]N#"), ("ip", "1##(.)N#(.)N(.)N"),
    ("card", "4###.####.####.####"), ("card", "5###/####/####/####"), ("card", "4### - #### - #### - ####"), ("card", "3### ###### #####"),
    ("phone", "(N##) ###-####"), ("phone", "N##-###-####"), ("phone", "N##.###.####"), ("phone", "0N# ### ####"), ("phone", "00N# ## ### ####"), ("phone", "0N##/######"),
]
BAD = [
    "~ at ~.~", "~ at ~ dot ~", "N#:##:##:##:##:##", "N###.####.####.####", "N### #### #### ####", "20## - 20##", "19##-20##", "N## ### ###", "N#.##.20##",
    "20##-##-##", "N##-N##", "N#/##", "N## ###", "N.##.###", "##-##-##-##-##", "N# ## ## ##", "978-N##-######-#", "N###-####", "3### ###### #####",
]
#: Of these no example is fitted: precision and recall are measured on them.
HELD_GOOD = [
    ("email", "~_~ [at] ~.io"), ("email", "~-~(at)~.co"), ("ip", "fe80:xxx:xxxx:xxx:xxxx:xxx:xxxx:xxxx"), ("ip", "N#(.)1##(.)N#(.)N#"), ("card", "6###_####_####_####"), ("card", "4###.####.####.####"),
    ("phone", "(0N#) ####-###"), ("phone", "N##/###/####"), ("phone", "00N# ### ### ###"),
]
HELD_BAD = ["N#.N#.20## N#:##", "20##/##/##", "N### N### N###", "N##.N##", "1##/20##", "##-####-##", "N#-N#-N#", "~ at ~ ##.##", "20## 20## 20##"]


def examples(n: int = EXAMPLES, seed: int = 11, good=GOOD, bad=BAD) -> list[tuple[str, int, int, int]]:
    """Sentences with one candidate each: text, the place of what was put in, and whether it
    is personal data."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ta", "re", "on", "in", "es", "the", "an", "li")) for _ in range(rng.randint(1, 3)))
    fill = lambda p: "".join(rng.choice("123456789") if c == "N" else rng.choice("0123456789") if c == "#" else rng.choice("0123456789abcdef") if c == "x" else word() if c == "~" else c for c in p)

    def card(p: str) -> str:
        out = fill(p)
        for d in "0123456789":
            trial = out[:-1] + d
            if sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(int(c) for c in reversed(trial) if c.isdigit())) % 10 == 0:
                return trial
        return out

    cue = {"email": ("mail me at", "contact:", "write to", ""), "ip": ("server", "host address", "ip:", ""), "card": ("my card", "pay with visa", "credit card no", ""), "phone": ("call", "phone:", "tel.", "my mobile is", "")}
    plain = ("order", "invoice", "isbn", "version", "pages", "score", "", "", "part no", "between", "on the")
    out = []
    for i in range(n):
        if i % 2:
            kind, pattern = rng.choice(good)
            item = card(pattern) if kind == "card" else fill(pattern)
            before = rng.choice(cue[kind]) if kind in ("phone", "email") and rng.random() < 0.9 else rng.choice(cue[kind])
            label = int(bool(before) or kind in ("ip", "card") or item.startswith("(") or "[" in item or "(at)" in item)
        else:
            item, before, label = fill(rng.choice(bad)), rng.choice(plain), 0
        head = f"{word()} {word()} {before} ".replace("  ", " ")
        out.append((f"{head}{item} {word()} {word()}.", len(head), len(head) + len(item), label))
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree: a leaf's value, or (feature, threshold, at most it, above it)."""
    value = float(g[rows].sum() / (h[rows].sum() + 1.0))
    best = (1e-6, None)
    if depth and len(rows) >= 12:
        base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[:-1]:
                a = x[rows, f] <= t
                if min(a.sum(), (~a).sum()) >= 6:
                    gain = sum(g[rows[m]].sum() ** 2 / (h[rows[m]].sum() + 1.0) for m in (a, ~a)) - base
                    if gain > best[0]:
                        best = (gain, (f, float(t)))
    if best[1] is None:
        return value
    f, t = best[1]
    a = x[rows, f] <= t
    return (f, t, grow(x, g, h, rows[a], depth - 1), grow(x, g, h, rows[~a], depth - 1))


def value_of(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(x: np.ndarray, y: np.ndarray) -> list:
    total, trees = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        tree = grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
        trees.append(tree)
        total += RATE * np.array([value_of(tree, r) for r in x])
    return trees


def calibrate(total: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve through held-out sums, by Newton's method."""
    w = np.array([1.0, 0.0])
    for _ in range(25):
        z = np.stack([total, np.ones_like(total)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = z.T @ (z * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        w = w + np.linalg.solve(curve, z.T @ (y - p) - 0.05 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


@lru_cache(maxsize=4)
def fitted(spark: SparkSession) -> tuple[list, tuple[float, float], tuple[float, ...]]:
    """Trees, calibration, and each kind's threshold: the least calibrated probability from
    which on held-out candidates are personal data in at least ``PRECISION`` of the cases."""
    made = examples()
    quoted = ", ".join(f"({i}, '{t}', {a}, {b}, {y})" for i, (t, a, b, y) in enumerate(made))
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(i, text, a, b, y)")
    rows = rows.select("i", "a", "b", "y", F.explode(candidates(F.col("text"))).alias("c"))
    got = rows.select("i", F.when((F.col("c.start") < F.col("b")) & (F.col("c.end") > F.col("a")), F.col("y")).otherwise(0).alias("y"), "c.f").collect()
    got = sorted(got, key=lambda r: (r["i"], r["f"]))
    x, y = np.array([r["f"] for r in got]), np.array([float(r["y"]) for r in got])
    third = np.array([r["i"] % 6 in (4, 5) for r in got])
    trees = boost(x[~third], y[~third])
    total = RATE * np.array([sum(value_of(t, r) for t in trees) for r in x[third]])
    scale, shift = calibrate(total, y[third])
    p = 1 / (1 + np.exp(-(scale * total + shift)))
    least = []
    for k in range(len(KINDS)):
        mine = x[third][:, 0] == k
        good = [t for t in np.unique(p[mine]) if y[third][mine & (p >= t)].mean() >= PRECISION]
        least.append(max(0.5, float(min(good))) if good else 1.1)
    return trees, (scale, shift), tuple(least)


def scored(trees: list, curve: tuple[float, float], f: Column) -> Column:
    def case(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(RATE * tree)
        return F.when(f[tree[0]] <= tree[1], case(tree[2])).otherwise(case(tree[3]))

    total = reduce(Column.__add__, map(case, trees))
    return 1 / (1 + F.exp(-(F.lit(curve[0]) * total + F.lit(curve[1]))))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spans``: ``spans`` is an array of ``kind, start, end, base`` by kind and place."""
    trees, curve, least = fitted(docs.sparkSession)
    rows = with_base(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def as_span(kind: Column, x: Column, base: bool) -> Column:
        return F.struct(kind.cast("int").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"))

    def of_kind(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: as_span(F.lit(i), x, True))

    base = F.concat(*map(of_kind, range(len(KINDS))))
    rows = rows.select("doc_id", "text", base.alias("base"), candidates(F.col("text")).alias("proposed"))
    limit = F.array(*map(F.lit, least))
    scores = F.transform("proposed", lambda c: F.struct(c["start"], c["end"], c["kind"], scored(trees, curve, c["f"]).alias("p")).cast(PROPOSED))
    rows = rows.withColumn("proposed", F.filter(scores, lambda c: c["p"] >= F.get(limit, c["kind"])))
    rows = rows.withColumn("proposed", free_of(F.col("base"), F.col("proposed")))
    added = F.transform(best_of(F.col("proposed")), lambda c: as_span(c["kind"], c, False))
    return rows.select("doc_id", "text", F.array_sort(F.concat("base", added)).alias("spans"), secrets(F.col("text")).alias("secrets"))


def secrets(text: Column) -> Column:
    """Quoted values of at least 16 characters after a word that names a secret."""
    return F.filter(spans(text, SECRET, SECRET_HINT), lambda x: x["s"].rlike("[0-9]"))


def redact(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, each span replaced by its kind in angle brackets, and secrets by ``<secret>``.
    Of spans that overlap the first is replaced."""
    names = F.array(*map(F.lit, (*KINDS, "secret")))
    hidden = F.transform("secrets", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(len(KINDS)).alias("kind")))
    by_place = F.array_sort(F.concat(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"])), hidden))

    def between(parts: Column, start: Column, n: Column) -> Column:
        """``n`` characters of the text from ``start``, read from its segments."""
        first = F.floor(start / F.lit(SEGMENT)).cast("int")
        some = F.slice(parts, first + 1, F.floor((start + n) / F.lit(SEGMENT)).cast("int") - first + 1)
        return F.substr(F.array_join(some, ""), start - first * SEGMENT + 1, n)

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        skip = x["start"] < acc["at"]
        put = F.array(between(acc["parts"], acc["at"], x["start"] - acc["at"]), F.concat(F.lit("<"), F.get(names, x["kind"]), F.lit(">")))
        state = F.struct(F.greatest(acc["at"], F.when(skip, acc["at"]).otherwise(x["end"])).alias("at"), acc["parts"].alias("parts"))
        return state, F.when(skip, F.array().cast("array<string>")).otherwise(put)

    last = F.floor(F.length("text") / F.lit(SEGMENT)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.substr(F.col("text"), k * SEGMENT + 1, F.lit(SEGMENT)))
    rows = find(docs).withColumn("done", walk(by_place, F.struct(F.lit(0).alias("at"), parts.alias("parts")), "string", step))
    at = F.col("done.state.at")
    whole = F.concat(F.array_join("done.out", ""), between(F.col("done.state.parts"), at, F.length("text") - at))
    return rows.select("doc_id", F.when(F.size("spans") + F.size("secrets") > 0, whole).otherwise(F.col("text")).alias("text"))


def listed(spans_of: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_of, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans counted by kind and hashed, all spans, and how many these and secrets are."""
    rows = find(docs).select("doc_id", "spans", "secrets", F.filter("spans", lambda x: x["base"]).alias("base"))

    def counted(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = list(map(counted, range(len(KINDS))))
    hidden = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", F.lit("secret"), x["start"].cast("string"), x["end"].cast("string"))), ",")
    total = (F.size("spans") + F.size("secrets")).cast("long")
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), hidden.alias("secrets"), total.alias("n_found"))
