"""Personal data: proposed spans, boosted trees, calibrated thresholds.

Generators with high recall propose overlapping spans per kind. Each candidate is described by
small integer features of its format (length, digits, separators, checksums) and of its context
(neighbouring characters, words before it). Boosted trees, trained on labelled synthetic sentences,
turn them into a probability; a threshold per kind, calibrated on sentences of other forms and other words than those of
training, selects what is redacted. Candidates of the base formats stay whatever their score.

Candidates, features and scores are DataFrame expressions; a trained tree is a CASE expression. Only
the counts of distinct feature vectors of the bounded synthetic set reach the driver, which grows the
trees from them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, table
from ._spans import as_text, let, matches, placed

KINDS = ("email", "ip", "card", "phone")
#: Stands for a single space or hyphen between two digits while cards are looked for.
_JOINT = "\ue000"

# The base formats. Starting at the edge of a run (or where the last match ended) and
# never giving characters back finds the same matches as the plain patterns, in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_JOINT}]{{12,}}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Further generators, without a base format: written-out addresses, dots in brackets, cards in groups, numbers without a plus.
_SPELLED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,4}"
_DEFANGED = r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(]\.[\])]\x20?[0-9]{1,3}){3}(?![0-9])"
_GROUPED = r"(?<![0-9])[0-9]{4}(?:[._/]|\x20{2}|\x20-\x20)[0-9]{4}(?:[._/]|\x20{2}|\x20-\x20)[0-9]{4}(?:[._/]|\x20{2}|\x20-\x20)[0-9]{4}(?![0-9])"
_ABROAD = r"(?<![0-9A-Za-z.+-])00[1-9][0-9]{0,2}[\x20.-](?:\(?[0-9]{1,4}\)?[\x20.-]?){2,5}(?<=[0-9])(?![0-9])"
_LOCAL_NUMBER = r"(?<![0-9A-Za-z.+-])(?<![0-9+][\x20().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"


@dataclass(frozen=True)
class BoostingParameters:
    """``sentences`` bounds the synthetic set; the part of it that is held out calibrates the thresholds."""

    sentences: int = 8_000
    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    l2: float = 1.0
    precision: float = 0.98


def joined_digits(text: Column) -> Column:
    """The text with each single space or hyphen between digits replaced, character for character."""
    plain = F.translate(text, _JOINT, "\ufffd")
    return F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits pass the checksum; every second one from the right counts double."""
    d = F.reverse(_digits(hit))
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(F.coalesce(v, F.lit(0))))
    return (total % 10 == 0) & (F.length(d) > 0)


def _between(hit: Column, low: int, high: int) -> Column:
    n = F.length(_digits(hit))
    return (n >= low) & (n <= high)


#: Generator, kind, pattern, what a text must hold, and the base format's condition (None: no base).
GENERATORS = (
    ("email", "email", _EMAIL, lambda t: t.contains("@"), lambda h: F.lit(True)),
    ("ip", "ip", _IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda h: h.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    ("card", "card", _CARD, lambda t: t.rlike(rf"[0-9{_JOINT}]{{13}}"), lambda h: F.when(_between(h, 13, 19), luhn(h)).otherwise(False)),
    ("phone", "phone", _PHONE, lambda t: t.contains("+"), lambda h: _between(h, 9, 15)),
    ("spelled", "email", _SPELLED, lambda t: F.lower(t).rlike(r"\(at\)|\[at\]"), None),
    ("local", "phone", _LOCAL_NUMBER, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), None),
    ("abroad", "phone", _ABROAD, lambda t: t.rlike(r"00[1-9][0-9]{0,2}[\x20.-]"), None),
    ("defanged", "ip", _DEFANGED, lambda t: t.rlike(r"[0-9]\x20?[\[(]\."), None),
    ("grouped", "card", _GROUPED, lambda t: t.rlike(r"[0-9]{4}[._/\x20][-\x20]?"), None),
)

_CONTEXT = {
    "mail_word": r"(?i)(?:e-?mail|mail|contact|write|reach)[^\n]{0,12}$",
    "phone_word": r"(?i)(?:phone|tel|call|mobile|fax|cell)[^\n]{0,12}$",
    "card_word": r"(?i)(?:card|visa|credit|payment|account)[^\n]{0,12}$",
    "net_word": r"(?i)(?:\bip|host|server|address|login)[^\n]{0,12}$",
    "count_word": r"(?i)(?:order|version|isbn|id|number|no|ref|page|part|model|invoice|ticket|serial|item|tracking|batch)\.?[^\n]{0,6}$",
}


def features_of(s: Column) -> Column:
    """Small integers that describe a candidate (generator, base, hit, before, after)."""
    hit, before, after = s["hit"], s["before"], s["after"]
    n = F.length(_digits(hit))
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    columns = [F.when(s["generator"] == g[0], 1).otherwise(0).alias(f"is_{g[0]}") for g in GENERATORS]
    columns += [
        s["base"].cast("int").alias("base"),
        F.least(F.length(hit), F.lit(40)).alias("length"),
        F.least(n, F.lit(20)).alias("digits"),
        F.least(F.length(F.regexp_replace(hit, r"[^\x20().\-]", "")), F.lit(8)).alias("marks"),
        hit.rlike(r"^[0-9]*$").cast("int").alias("bare"),
        F.when(n.between(12, 20), luhn(hit)).otherwise(False).cast("int").alias("checksum"),
        hit.rlike(r"[A-Za-z]{2}$").cast("int").alias("word_end"),
        F.least(F.size(groups), F.lit(8)).alias("groups"),
        F.exists(groups, lambda g: F.length(g) > 4).cast("int").alias("long_group"),
        F.exists(groups, lambda g: (F.length(g) <= 4) & (g.try_cast("int") > 255)).cast("int").alias("over_octet"),
        before.rlike(r"[A-Za-z0-9_]$").cast("int").alias("glued_before"),
        after.rlike(r"^[A-Za-z0-9_]").cast("int").alias("glued_after"),
    ]
    columns += [before.rlike(p).cast("int").alias(name) for name, p in _CONTEXT.items()]
    return F.struct(*columns)


FEATURES = tuple([f"is_{g[0]}" for g in GENERATORS] + ["base", "length", "digits", "marks", "bare", "checksum", "word_end", "groups", "long_group", "over_octet", "glued_before", "glued_after", *_CONTEXT])


def candidates(rows: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """All proposed spans as one array column ``spans`` of (generator, kind, start, end, hit, base, before, after)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ready = rows.select(*id_cols, text.alias("t")).withColumn("joined", F.when(F.col("t").rlike(r"[0-9][0-9\x20-]{11}"), joined_digits(F.col("t"))).otherwise(F.lit("")))
    source = {g[0]: F.col("joined" if g[0] == "card" else "t") for g in GENERATORS}
    searched = ready.select(*id_cols, "t", *[matches(source[g], p, 0, need(source[g])).alias(f"m_{g}") for g, _, p, need, _ in GENERATORS])
    t = F.col("t")

    def described(g: str, kind: str, base) -> Column:
        def one(s: Column) -> Column:
            return F.struct(
                F.lit(g).alias("generator"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
                (base(s["hit"]) if base else F.lit(False)).alias("base"),
                F.substr(t, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("before"), F.substr(t, s["end"] + 1, F.lit(1)).alias("after"),
            )

        return F.transform(placed(F.col(f"m_{g}")), one)

    return searched.select(*id_cols, F.concat(*[described(g, kind, base) for g, kind, _, _, base in GENERATORS]).alias("spans"))


# The synthetic set: forms in carriers. In a form # is a digit, @ a name, % the name of a domain and & sixteen digits that pass the
# checksum; in a carrier ~ is the form. Even and odd places are apart: even forms in even carriers train, odd ones in odd carriers calibrate.
_POSITIVE = {
    "email": ("@.@#@mail.%.com", "@@%.org", "@_@##@%-%.net", "@+news@%.example.com", "@(at)%.com", "@.@ (at) %.org", "@ [at] % [dot] org", "@.@[at]%(dot)net", "@#(at)%.co.uk", "@_@ [at] %.%.com", "@ (at) % (dot) com", "@(at)% [dot] net"),
    "phone": ("+1 (###) ###-####", "+## ### ######", "+##.##.##.##.##", "+44 #### ######", "###-###-####", "(###) ###-####", "###.###.####", "### ### ####", "00## ### ### ###", "001 ### ### ####", "0044 #### ### ###", "0033 # ## ## ## ##"),
    "card": ("&", "&", "4111 1111 1111 1111", "5500-0055-5555-5559", "4111.1111.1111.1111", "5500  0055  5555  5559", "4012_8888_8888_1881", "4012/8888/8888/1881"),
    "ip": ("1#.2#.##.1##", "10.0.#.1#", "1##.##.#.2#", "192.168.#.##", "10[.]0[.]#[.]1#", "192(.)168(.)#(.)##", "1## [.] 2# [.] # [.] ##", "172[.]16[.]##[.]#"),
}
_NEGATIVE = {
    "email": ("@ (at) %", "@.@ version #(at)#", "% (at) #.##", "@ [at] #.#"),
    "phone": ("###-###-####", "###.###.####", "### ### ####", "(###) ###-####", "00# ### ###", "00## ##.##.##"),
    "card": ("9999999999999999", "#111222233334444", "#### #### #### ####", "00## #### ### ###", "3141592653589793238", "1234.5678.9012.345#", "####  ####  ####  ####", "20##/20##/20##/20##", "##-##-####-####-##", "0#########-####"),
    "ip": ("300.4##.5##.6", "999.1.2.#", "1.2.3.4##", "4##.#.#.#", "9##[.]1[.]2[.]3", "400(.)#(.)#(.)#"),
}
_SAID = {
    "email": ("please write to ~ soon", "e-mail ~ for news", "contact @ at ~ today", "reach me under ~ or not", "mail: ~", "my contact is ~."),
    "phone": ("call ~ now", "tel: ~", "my phone is ~ at home", "mobile ~ or fax", "fax ~, ask for @", "cell ~ after six"),
    "card": ("pay by card ~ please", "visa ~ expires soon", "credit card ~", "the payment account ~ of @"),
    "ip": ("login from ~ failed", "server ~ is down", "host ~ said no", "ip address ~"),
}
_COUNTED = ("order ~ was sent", "isbn ~ paper", "ref ~ of page", "part no ~ fits", "version ~ of it", "ticket ~ is open", "serial ~ is worn", "item ~ in the box", "tracking ~ to @", "invoice ~ is due")
_PLAIN = ("it was ~ there", "and ~ was it", "~", "so ~ it is")


def _templates() -> list[tuple[str, bool, str]]:
    """(kind of personal data or nothing, whether it calibrates, text): forms of personal data where they are spoken of or in plain words, and other
    forms and counted things. Forms that look like either are personal data only where a carrier says so."""
    out = []
    for held in (False, True):
        own = lambda xs: xs[held::2]  # noqa: E731, B023
        for kind in KINDS:
            both = set(_POSITIVE[kind]) & set(_NEGATIVE[kind])
            for form in own(_POSITIVE[kind]):
                carriers = own(_SAID[kind]) + (() if form in both else own(_PLAIN))
                out += [(kind, held, c.replace("~", form)) for c in carriers]
            for form in own(_NEGATIVE[kind]):
                out += [("", held, c.replace("~", form)) for c in own(_COUNTED) + (() if form in both else own(_PLAIN))]
    return out


def _check_digit(digits: Column) -> Column:
    """The digit that, put behind, makes the checksum pass."""
    backwards = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return ((10 - F.aggregate(backwards, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10) % 10).cast("string")


def _listed(values) -> Column:
    """An array of strings from one literal, which keeps plans small."""
    return F.split(F.lit("\n".join(values)), "\n")


def synthetic_sentences(spark: SparkSession, n: int) -> DataFrame:
    """(``id``, ``text``, ``says``, ``held``): ``n`` sentences from the templates, filled by hashes of the id. Written once."""
    templates = _templates()
    known = spark.range(1).select(F.posexplode(_listed([f"{kind}\t{int(held)}\t{text}" for kind, held, text in templates])).alias("place", "line"))
    known = known.select("place", *[F.get(F.split("line", "\t"), F.lit(k)).alias(c) for k, c in enumerate(("says", "held", "text"))])
    parts = [_listed(words) for words in (("an", "li", "sam", "mar", "ol", "ki", "jo", "per", "ed", "tom"), ("na", "a", "uel", "ie", "ga", "m", "sef", "la", "gar", "ek"), ("", "", "son", "s", "-lee", ".k", "sen", "1"))]
    # as many rows as there are templates
    rows = spark.range(n).withColumn("place", F.pmod(F.col("id"), F.lit(len(templates))).cast("int")).join(F.broadcast(known), "place")
    pick = lambda what, i, size: F.pmod(F.xxhash64(F.col("id"), F.lit(what), i), F.lit(size))
    word = lambda what, i: F.concat(*[F.get(p, pick(what + str(k), i, size).cast("int")) for k, (p, size) in enumerate(zip(parts, (10, 10, 8)))])
    number = lambda i: F.concat(F.lit("4"), F.lpad(pick("card", i, 10**14).cast("string"), 14, "0"))

    def filled(chars: Column) -> Column:
        # an @ before the name of a domain is the sign itself
        return F.transform(
            chars,
            lambda c, i: F.when(c == "#", pick("digit", i, 10).cast("string"))
            .when((c == "@") & ~F.coalesce(F.get(chars, i + 1).rlike("^[%m]$") & F.get(chars, i - 1).rlike("^[@#s]$"), F.lit(False)), word("name", i))
            .when(c == "%", F.regexp_replace(word("domain", i), "[^a-z]", ""))
            .when(c == "&", let(number(i), lambda d: F.concat(d, _check_digit(d))))
            .otherwise(c),
        )

    text = F.array_join(let(F.split("text", ""), filled), "").alias("text")
    return materialise(rows.select("id", text, "says", (F.col("held") == "1").alias("held")), "sentences")


Tree = list  # [feature, cut, left, right], a leaf is a number


def grow(rows: list[tuple[tuple, float, float]], p: BoostingParameters) -> tuple[float, list]:
    """Boosted trees on (features, positives, all) by second-order gain; the start is the base rate's logit."""
    total, positive = sum(r[2] for r in rows), sum(r[1] for r in rows)
    start = math.log((positive + 1) / (total - positive + 1))
    margin = [start] * len(rows)

    def fit(own: list[int], g: list[float], h: list[float], depth: int):
        sg, sh = sum(g[i] for i in own), sum(h[i] for i in own)
        leaf = -p.rate * sg / (sh + p.l2)
        if depth == 0 or len(own) < 2:
            return leaf
        best = (1e-6, None, None)
        for f in range(len(FEATURES)):
            by: dict = defaultdict(lambda: [0.0, 0.0])
            for i in own:
                cell = by[rows[i][0][f]]
                cell[0] += g[i]
                cell[1] += h[i]
            lg = lh = 0.0
            for v in sorted(by)[:-1]:
                lg += by[v][0]
                lh += by[v][1]
                gain = lg * lg / (lh + p.l2) + (sg - lg) ** 2 / (sh - lh + p.l2) - sg * sg / (sh + p.l2)
                if gain > best[0]:
                    best = (gain, f, v)
        if best[1] is None:
            return leaf
        _, f, cut = best
        left, right = [i for i in own if rows[i][0][f] <= cut], [i for i in own if rows[i][0][f] > cut]
        return [f, cut, fit(left, g, h, depth - 1), fit(right, g, h, depth - 1)]

    trees = []
    for _ in range(p.rounds):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        g = [q * r[2] - r[1] for q, r in zip(prob, rows)]
        h = [q * (1 - q) * r[2] for q, r in zip(prob, rows)]
        tree = fit(list(range(len(rows))), g, h, p.depth)
        trees.append(tree)
        for i, r in enumerate(rows):
            margin[i] += _leaf(tree, r[0])
    return start, trees


def _leaf(tree, features: tuple) -> float:
    while isinstance(tree, list):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _case(tree, features: Column) -> Column:
    if not isinstance(tree, list):
        return F.lit(float(tree))
    return F.when(features[FEATURES[tree[0]]] <= tree[1], _case(tree[2], features)).otherwise(_case(tree[3], features))


def train(spark: SparkSession, p: BoostingParameters = BoostingParameters()) -> tuple[float, list, dict[str, float]]:
    """Start, trees, and the margin from which each kind is selected with the wanted precision."""
    found = candidates(synthetic_sentences(spark, p.sentences), ["id", "says", "held"]).select("id", "says", "held", F.explode("spans").alias("s"))
    # a candidate is right where the sentence says data of its kind
    label = (F.col("says") == F.col("s.kind")).cast("int").alias("label")
    vectors = found.select(label, "held", F.col("s.kind").alias("kind"), features_of(F.col("s")).alias("features")).groupBy("kind", "features", "held").agg(F.sum("label").alias("y"), F.count("*").alias("n"))
    fit, held = [], defaultdict(list)
    for r in vectors.orderBy("kind", "features", "held").collect():  # at most one row per synthetic candidate
        row = (tuple(r["features"]), float(r["y"]), float(r["n"]))
        held[r["kind"]].append(row) if r["held"] else fit.append(row)
    start, trees = grow(fit, p)
    cuts = {}
    for kind in KINDS:
        by: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for x, y, n in held[kind]:
            cell = by[start + sum(_leaf(t, x) for t in trees)]
            cell[0] += y
            cell[1] += n
        cuts[kind], good, every = math.inf, 0.0, 0.0
        for margin in sorted(by, reverse=True):  # equal margins are let in together
            good, every = good + by[margin][0], every + by[margin][1]
            if good / every >= p.precision:
                cuts[kind] = margin
    return start, trees, cuts


def pii_spans(docs: DataFrame, p: BoostingParameters = BoostingParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``all`` (arrays of start, rank, end, kind).

    ``all`` holds every base span and the other candidates that the trees select, unless a base span
    of the same kind overlaps them.

    Defined results: a null or empty text holds nothing; repeated rows and rows without an identifier
    are searched each; an empty table gives an empty result; texts are searched whole.
    """
    start, trees, cuts = train(docs.sparkSession, p)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = candidates(rows, ["doc_id"])
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    short = lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    base = F.transform(F.filter("spans", lambda s: s["base"]), short)
    found = found.select("doc_id", base.alias("base"), F.filter("spans", lambda s: ~s["base"]).alias("rest"))

    cut = F.create_map(*[F.lit(v) for kind in KINDS for v in (kind, float(cuts[kind]))])
    free = F.filter("rest", lambda s: ~F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (b["end"] > s["start"])))
    scored = found.select("doc_id", "base", F.transform(free, lambda s: F.struct(short(s).alias("span"), features_of(s).alias("x"), s["kind"].alias("kind"))).alias("free"))

    def chosen(s: Column) -> Column:
        total = F.lit(start)
        for tree in trees:
            total = total + _case(tree, s["x"])
        return total >= cut[s["kind"]]

    return scored.select("doc_id", "base", F.concat("base", F.transform(F.filter("free", chosen), lambda s: s["span"])).alias("all"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    first = lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    by_kind = lambda name: as_text(F.array_sort(F.transform(name, first)))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(by_kind("base").cast("binary"), 256).alias("base_sha256"), by_kind("all").alias("spans"))
