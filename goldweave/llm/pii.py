"""Personal data: fixed forms, and contextual extraction bootstrapped from them.

The fixed forms (email, IP address, payment card, phone) are the seeds.  The
words before a seed, a label or the words after it are lexical patterns.
Patterns and the candidate identifiers beside them form a bipartite graph,
scored in rounds: a pattern is as good as the share of its instances that are
believed, an instance is as good as its best pattern, an identifier as its
instances together.  Candidates beside patterns of high confidence become
further spans and seeds of further patterns.  DataFrame functions only.

Quantifiers are possessive and searches start at the edge of a run wherever
that leaves the matches as they are: Java's backtracking would otherwise take
quadratic time, or its stack, on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.common import marked, materialise, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A token that may be an identifier: at least three digits among letters, digits and joints.
_EDGE = r"(?<![A-Za-z0-9._:/@+-])(?=[A-Za-z._:/@+-]*+[0-9][A-Za-z._:/@+-]*+[0-9][A-Za-z._:/@+-]*+[0-9])"
_TOKEN = r"[A-Za-z0-9+][A-Za-z0-9._:/@-]{4,}+"
CANDIDATE = _EDGE + _TOKEN
_JOINT = r"[\x20().-]"
_LEAD = r"(?:\+?\((?=\+?[0-9]{1,5}\))\+?|\+)?+"
_GROUPS = rf"(?={_LEAD}(?:[0-9]{_JOINT}{{0,3}}+){{7}})(?!{_LEAD}(?:[0-9]{_JOINT}{{0,3}}+){{20}}){_LEAD}[0-9]++(?:{_JOINT}{{1,3}}+[0-9]{{2,}}+)++(?![A-Za-z0-9@])"
#: Groups of 7 to 19 digits joined by blanks, brackets, points and hyphens, from the first bracket, sign or digit on.
GROUPS = rf"(?=[0-9(+])(?<![A-Za-z0-9._@+/-])(?<![0-9]{_JOINT}{{1,3}}){_GROUPS}"
_AT, _DOT = r"\x20?[\[({<]\x20?(?i:at)\x20?[\])}>]\x20?", r"\x20?[\[({<]\x20?(?i:dot)\x20?[\])}>]\x20?|\x20(?i:dot)\x20"
_LABEL, _HOST = r"[A-Za-z][A-Za-z0-9-]*+", r"(?=[0-9-]*+[A-Za-z])[A-Za-z0-9-]++"
#: Spelled-out addresses: 'bob at corp dot com', 'bob [at] corp.com', 'bob @ corp . com', 'bob@corp'.
SPELLED = rf"(?<!{_LOCAL}){_LOCAL}++(?:(?:{_DOT}){_LOCAL}++){{0,4}}+(?:(?:{_AT}|\x20?@\x20?){_HOST}(?:(?:{_DOT}|\x20?\.\x20?(?=[A-Za-z]{{2,6}}(?![A-Za-z])))[A-Za-z0-9-]++)*+|\x20(?i:at)\x20{_HOST}(?:(?:{_DOT}|\.){_LABEL})++)"
#: A cheap test that every text with a spelled-out address passes.
SPELLED_HINT = r"@|[\[({<]\x20?(?i:at)\x20?[\])}>]|\x20(?i:at)\x20[A-Za-z0-9-]++(?:\.[A-Za-z]|\x20?[\[({<]\x20?(?i:dot)|\x20(?i:dot)\x20)"
#: The others; a token that begins with a label leaves the groups behind it whole.
NUMBERS = rf"{GROUPS}|{_EDGE}(?![A-Za-z._-]{{1,30}}+:{_GROUPS}){_TOKEN}"
#: All of them in one search.
LOOSE = rf"{SPELLED}|{NUMBERS}"
_SPAN = "array<struct<start:int,stop:int,surface:string>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    backwards = F.split(F.reverse(number), "")
    worth = F.transform(
        F.filter(backwards, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, surface: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(surface, r"\."), lambda part: part.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    n = F.length(digits(surface))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(surface))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches with their places in code points: array of (start, stop, surface)."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["b"])
        z = a + F.length(x["m"])
        return F.struct(z.alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), z.alias("stop"), x["m"].alias("surface")))).alias("spans"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    return spans if hint is None else F.when(text.rlike(hint), spans).otherwise(F.array().cast(_SPAN))


def loose_spans(text: Column) -> Column:
    """All matches of ``LOOSE``; most texts are spared the search for spelled-out addresses, or any."""
    return F.when(text.rlike(SPELLED_HINT), located(text, LOOSE)).otherwise(located(text, NUMBERS, "[0-9]"))


def _of_kind(text: Column, kind: str) -> Column:
    good = F.filter(located(text, PATTERNS[kind], HINTS[kind]), lambda s: valid(kind, s["surface"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["surface"].alias("surface")))


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms, by kind as listed, then start: array of (kind, start, stop, surface)."""
    kinds = [_of_kind(text, k) for k in KINDS]
    return F.concat(*kinds)


def contexts(text: Column, start: Column, stop: Column, reach: int = 64) -> Column:
    """The contexts of a place that compete, lower-cased, digits as 0: two and one words before, a label before a colon or equals sign, one and two words after.

    Opening brackets and quotes right before the place, and closing ones right after it, are passed over.
    """
    before = F.lower(F.substring(text, F.greatest(start - reach + 1, F.lit(1)), F.least(start, F.lit(reach))))
    before = F.regexp_replace(before, "[(\\[{<\"'`\u201c\u201e\u2018\u00ab]{1,4}$", "")
    after = F.lower(F.substring(text, stop + 1, reach))
    one, two = r"[^\s]{1,30}\s{1,3}", r"\s{1,3}([^\s]{1,30})"
    closed = "^[)\\]}>\"'`\u201d\u201c\u2019\u00bb,;]{0,4}"
    found = {
        "2": F.regexp_extract(before, rf"((?:{one}){{2}}|[^\s]{{3,30}}[=:])$", 1),
        "1": F.regexp_extract(before, rf"({one})$", 1),
        "label": F.regexp_extract(before, r"([^\s:=]{2,30}\s{0,2}[:=])\s{0,3}$", 1),
        "next": F.regexp_extract(after, closed + two, 1),
        "next 2": F.regexp_extract(after, closed + r"(\s{1,3}[^\s]{1,30}\s{1,3}[^\s]{1,30})", 1),
    }
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[0-9]", "0")
    return F.filter(F.array(*[F.when(c != "", F.concat(F.lit(name + "|"), plain(c))) for name, c in found.items()]), lambda c: c.isNotNull())


def form(surface: Column) -> Column:
    """What a candidate looks like: ``digits``, ``email``, or null for a token that may be of any kind."""
    number = surface.rlike(r"^[0-9\x20().+-]+$") & F.length(digits(surface)).between(7, 19)
    return F.when(number, "digits").when(surface.rlike(r"@|[\x20\[({<](?i:at)[\x20\])}>]"), "email")


def with_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text hash, ``base`` spans, and ``instances``: seeds and candidates with their contexts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    loose = loose_spans(F.col("text"))
    df = df.withColumn("loose", F.filter(loose, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))
    shape = lambda s, kind: F.struct(kind.alias("kind"), form(s["surface"]).alias("form"), s["start"].alias("start"), s["stop"].alias("stop"), F.lower(s["surface"]).alias("surface"), contexts(F.col("text"), s["start"], s["stop"]).alias("contexts"))
    seeds = F.transform("base", lambda s: shape(s, s["kind"]))
    others = F.transform("loose", lambda s: shape(s, F.lit(None).cast("string")))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return df.select("id", F.xxhash64("text").alias("text_key"), plain.alias("base"), F.filter(F.concat(seeds, others), lambda x: F.size(x["contexts"]) > 0).alias("instances"))


def fits(kind: str) -> Column:
    """May a candidate of this ``form`` be of the kind in a column?"""
    return F.col("form").isNull() | F.when(F.col("form") == "email", F.col(kind) == "email").otherwise(F.col(kind).isin("card", "phone", "ip"))


def bootstrap(found: DataFrame, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.8) -> DataFrame:
    """Accepted patterns: (context, kind, score), from the instances of all documents.

    A pattern needs ``least_seeds`` different believed identifiers of a kind and
    a score of ``confidence``: the share of all different identifiers behind it
    that are believed to be of that kind.  Believed are the seeds and, from
    generation to generation, the identifiers behind accepted patterns, as much
    as their best pattern; the patterns are built anew from them until a
    generation believes nothing new.  Within a generation patterns and
    identifiers score each other in ``rounds``.
    """
    each = found.select(F.explode("instances").alias("x")).select("x.*")
    # one edge per context and identifier, however many rows repeat it; a seed keeps its kind
    edges = materialise(each.select("surface", "kind", "form", F.explode("contexts").alias("context")).groupBy("context", "surface").agg(F.max("kind").alias("kind"), F.max("form").alias("form")), "edges")
    # the contexts of one instance compete: only the best of them counts for its identifier
    places = each.where(F.col("kind").isNull()).select("surface", "contexts").distinct().select("surface", F.xxhash64("contexts").alias("place"), F.explode("contexts").alias("context"))
    places = materialise(places, "places")
    believed, accepted, size = None, None, 0
    while True:
        rows = edges.withColumns({"k": F.col("kind"), "sure": F.lit(1.0)})
        if believed is not None:
            rows = edges.join(believed, "surface", "left").withColumns({"sure": F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("held")), "k": F.coalesce("kind", "held_kind")}).drop("held", "held_kind")
        kinds = rows.where(F.col("k").isNotNull()).groupBy("context", F.col("k").alias("of")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
        graph = materialise(rows.join(kinds.select("context", "of"), "context").where(F.col("kind").isNotNull() | fits("of")), "graph")
        belief, patterns = None, None
        for _ in range(rounds):
            known = F.when(F.col("k") == F.col("of"), F.col("sure")).when(F.col("k").isNotNull(), 0.0)
            trusted = graph if belief is None else graph.join(belief, ["surface", "of"], "left")
            trusted = trusted.withColumn("trust", F.coalesce(known, F.lit(0.0) if belief is None else F.col("belief"), F.lit(0.0)))
            # a smoothed share: identifiers of other kinds, and doubtful ones, count against a pattern
            scored = trusted.groupBy("context", "of").agg((F.sum("trust") / (F.count("*") + 0.5)).alias("score"))
            patterns = materialise(scored.where(F.col("score") >= 0.5), "patterns")
            best = places.join(patterns, "context").groupBy("surface", "of", "place").agg(F.max(F.struct("score", "context")).alias("b")).select("surface", "of", "b.*").distinct()
            doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6))))
            belief = best.groupBy("surface", "of").agg((1 - F.exp(doubt)).alias("belief"))
        best = patterns.where(F.col("score") >= confidence).groupBy("context").agg(F.max(F.struct("score", "of")).alias("b"))
        fresh = best.select("context", F.col("b.of").alias("kind"), F.col("b.score").alias("score"))
        # a pattern once accepted stays, so that what is believed only grows
        accepted = materialise(fresh if accepted is None else accepted.unionByName(fresh.join(accepted, "context", "left_anti")), "accepted")
        behind = edges.where("kind is null").select("context", "surface", "form").join(accepted, "context").where(fits("kind")).groupBy("surface").agg(F.max(F.struct("score", "kind")).alias("b"))
        believed = materialise(behind.select("surface", F.col("b.kind").alias("held_kind"), F.col("b.score").alias("held")), "believed")
        before, size = size, believed.count()
        if size == before:
            return accepted


def added_spans(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """(id, text_key, added): the candidates with accepted patterns, each of its best pattern's kind; their number is not bounded, so this join is shuffled."""
    loose = found.select("id", "text_key", F.explode("instances").alias("x")).where(F.col("x.kind").isNull()).select("id", "text_key", "x.form", "x.start", "x.stop", F.explode("x.contexts").alias("context"))
    each = loose.join(accepted, "context").where(fits("kind")).groupBy("id", "text_key", "start", "stop").agg(F.max(F.struct("score", "kind")).alias("b"))
    return each.groupBy("id", "text_key").agg(F.collect_set(F.struct(F.col("b.kind").alias("kind"), "start", "stop")).alias("added"))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``text_key``, ``base`` and ``spans`` (kind, start, stop), by kind as listed, then start.

    A null text is empty and has no spans.  Repeated rows give rows of their
    own; other columns are not read.  Places are in code points, ends exclusive.
    """
    found = materialise(with_spans(df, id_col, text_col), "personal")
    accepted = bootstrap(found)
    added = added_spans(found, accepted)
    out = found.alias("f").join(added.alias("a"), F.col("f.id").eqNullSafe(F.col("a.id")) & (F.col("f.text_key") == F.col("a.text_key")), "left")
    every = F.concat(F.col("base"), F.coalesce(F.col("added"), F.array().cast("array<struct<kind:string,start:int,stop:int>>")))
    of = lambda k: F.array_sort(F.filter(every, lambda s: s["kind"] == k))
    ordered = F.flatten(F.array(*map(of, KINDS)))
    return out.select(F.col("f.id").alias(id_col), F.col("f.text_key").alias("text_key"), "base", ordered.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (overlaps united) replaced by its kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    out = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed forms alone, as ``op3_bootstrapped_pii`` finds them: what SQL can say of its result."""
    return op3_bootstrapped_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256")


def mask_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by its kind; null texts stay null.

    Fixed forms are masked in place, without a shuffle.  Only where patterns
    were accepted do the rows that they reach meet their added spans.
    """
    found = materialise(with_spans(df, id_col, text_col), "personal")
    accepted = bootstrap(found)
    plain = lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.transform(base_spans(text), plain).alias("base"))
    if accepted.isEmpty():
        rows = rows.withColumn("added", none)
    else:
        # only rows that the bitmap marks can have added spans, so only their texts are shuffled
        added = materialise(added_spans(found, accepted), "added")
        rows = marked(rows, added.select("id"))
        same = F.col("r.id").eqNullSafe(F.col("a.id")) & (F.col("r.text_key") == F.col("a.text_key"))
        some = rows.where("_mark or id is null").alias("r").join(added.alias("a"), same, "left").select("row", "base", "added")
        rows = rows.where("not (_mark or id is null)").select("row", "base", none.alias("added")).unionByName(some)
    spans = F.concat("base", F.coalesce("added", none))
    return rows.select(F.col("row").withField(text_col, masked(F.col("row")[text_col], spans)).alias("row")).select("row.*")
