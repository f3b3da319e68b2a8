"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Strict finders give seed entities. The words around them are lexical patterns; loose finders give spans that look
like an identifier without being one to the strict rules (obfuscated, mistyped or written another way). Patterns and
instances form a bipartite graph. Each round scores a pattern by the share of its instances that is known for a kind, scores an
unknown instance by the patterns it stands in, and takes the surest ones into what is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from advisorylake.session import Scratch

KINDS = ("email", "ip", "card", "phone")

#: Strict finders. A run is entered at its first character or where the last match ended, and never given back, so that
#: matching takes linear time and no stack; the matches are those of the plain patterns.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[({<] ?(?:at|@) ?[\])}>] ?| at |@)", r"(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot |\.)"
#: What an identifier of the kind may look like otherwise.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ./_-]?[0-9]{3,4}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[ -]?)?\(?[0-9]{2,4}\)?(?:[ ./-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
_MAIL = r"@|[\[({<] ?(?:at|@)| at .* dot "
#: Texts without a hit of these have no match.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}, {"email": _MAIL, "ip": "[0-9]", "card": "[0-9]{3}", "phone": "[0-9]{2}"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters of a text kept on either side of a match, for its context.
CONTEXT = 60

_MATCH = "array<struct<strict: boolean, kind: int, i: int, gap: int, head: string, tail: string, found: string>>"


def _matches(text: Column, kind: int, strict: bool) -> Column:
    """The pieces between matches with the match that follows each, in order; empty without any match."""
    name = KINDS[kind]
    pattern, need = (STRICT if strict else LOOSE)[name], _NEEDS[not strict][name]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    parts = F.transform(zipped, lambda z, i: F.struct(
        F.lit(strict).alias("strict"), F.lit(kind).alias("kind"), i.alias("i"), F.length(z["piece"]).alias("gap"),
        F.substring(z["piece"], 1, CONTEXT).alias("head"), F.substring(z["piece"], -CONTEXT, CONTEXT).alias("tail"), z["found"].alias("found")))
    some = F.filter(parts, lambda p: (p["i"] > 0) | p["found"].isNotNull())
    hit = text.contains(need) if need == "@" else text.rlike(f"(?s){need}")
    return F.coalesce(F.when(hit, some).cast(_MATCH), F.array().cast(_MATCH))


def _valid(strict: Column, kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    is_ip = found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    exact = (F.when(kind == 1, is_ip).when(kind == 2, n.between(13, 19) & F.call_function("luhn_check", digits))
             .when(kind == 3, n.between(9, 15)).otherwise(True))
    return F.when(strict, exact).otherwise(F.when(kind == 2, n.between(13, 19)).when(kind == 3, n.between(9, 15)).otherwise(True))


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[\"'`(){}<>\[\]]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def spans_of(matches: DataFrame) -> DataFrame:
    """(row, strict, kind, start, end, value, left, right) of the valid matches; places count code points, the end is exclusive.

    ``matches`` has (row, matches). ``value`` is the match in lower case; ``left`` and ``right`` are the words around it.
    """
    parts = matches.select("row", F.inline("matches"))
    run = W.partitionBy("row", "strict", "kind").orderBy("i")
    before = F.sum(F.col("gap") + F.length("found")).over(run.rowsBetween(W.unboundedPreceding, -1))
    placed = parts.select("row", "strict", "kind", "found", "tail", F.lead("head").over(run).alias("behind"),
                          (F.coalesce(before, F.lit(0)) + F.col("gap")).cast("long").alias("start"))
    return placed.where(F.col("found").isNotNull() & _valid(F.col("strict"), F.col("kind"), F.col("found"))).select(
        "row", "strict", "kind", "start", (F.col("start") + F.length("found")).alias("end"), F.lower("found").alias("value"),
        _words(F.col("tail")).alias("left"), _words(F.coalesce("behind", F.lit(""))).alias("right"))


def lexical_patterns(left: Column, right: Column) -> Column:
    """The word before, the two words before, and the words on both sides."""
    one, two, after = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(right, F.lit(1))
    edge = lambda w: F.coalesce(w, F.lit("^"))
    return F.array(F.concat(F.lit("1 "), edge(one)), F.concat(F.lit("2 "), edge(two), F.lit(" "), edge(one)),
                   F.concat(F.lit("3 "), edge(one), F.lit(" _ "), edge(after)))


def _unseen(spans: DataFrame) -> DataFrame:
    """Loose spans that overlap no strict one of their text."""
    side = W.partitionBy("row").orderBy("start", F.col("strict").desc())
    reach = F.max(F.when(F.col("strict"), F.col("end"))).over(side.rowsBetween(W.unboundedPreceding, -1))
    # The same order backwards: a frame to the end of a partition would be summed up anew for every row.
    back = W.partitionBy("row").orderBy(F.col("start").desc(), F.col("strict"))
    ahead = F.min(F.when(F.col("strict"), F.col("start"))).over(back.rowsBetween(W.unboundedPreceding, -1))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (ahead.isNull() | (ahead >= F.col("end")))
    return spans.withColumn("free", free).where(F.col("strict") | F.col("free")).drop("free")


def bootstrap(spans: DataFrame, scratch: Scratch, rounds: int = 3, least_known: int = 2, least_share: float = 0.5,
              sure: float = 0.8) -> DataFrame:
    """(kind, value, score) of the unknown instances that context makes identifiers of a kind.

    A pattern's share for a kind is known / (n + 1): of its n different instances, those of the kind that are strict or taken in
    an earlier round. Patterns with ``least_known`` known instances and a share of ``least_share`` vote; the score of an
    instance is 1 - product of (1 - share) over the patterns it stands in, and one of ``sure`` or more is taken. Copies
    of a text add no weight, since every pattern and value counts once.
    """
    edges = scratch.write(spans.select("kind", "value", "strict", F.explode(lexical_patterns(F.col("left"), F.col("right"))).alias("pattern")).groupBy(
        "pattern", "kind", "value").agg(F.max("strict").alias("known")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least_known)
    # Only patterns around something unknown can discover anything.
    open_ = edges.where("NOT known").select("pattern").distinct()
    graph = scratch.write(edges.join(sizes, "pattern").join(open_, "pattern", "left_semi"), "graph")
    unknown = graph.where("NOT known")
    taken = scratch.write(unknown.select("kind", "value", F.lit(0.0).alias("score")).limit(0), "taken")
    for _ in range(rounds):
        won = unknown.join(taken.select("kind", "value"), ["kind", "value"], "left_semi").select("pattern", "kind")
        known = graph.where("known").select("pattern", "kind", F.lit(1).alias("k")).unionByName(won.withColumn("k", F.lit(1))).groupBy(
            "pattern", "kind").agg(F.sum("k").alias("k")).where(F.col("k") >= least_known)
        share = F.col("k") / (F.col("n") + 1)
        # In millionths, so that sums do not depend on the order of rows.
        votes = unknown.join(known, ["pattern", "kind"]).where(share >= least_share).withColumn(
            "vote", F.floor(-F.ln(1 - share) * 1_000_000).cast("long"))
        score = 1 - F.exp(-F.sum("vote") / 1_000_000)
        taken = scratch.write(votes.groupBy("kind", "value").agg(score.alias("score")).where(F.col("score") >= sure), "taken")
    return taken


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """(id_col, base, added) for every row of ``docs``: arrays of struct<kind, start, end> by kind, then start.

    ``base`` are the strict matches, leftmost and without overlap in each kind, that pass the checks of their kind (four octets up to
    255; 13 to 19 digits with a Luhn sum; 9 to 15 digits). ``added`` are spans that the bootstrap discovered. They overlap no
    base span, and none of them overlaps an added one that starts before it (at the same start the earlier kind stays).

    Null and empty texts have no spans. Rows of equal or null id stay rows of their own, an empty table gives no rows,
    and extra columns are ignored. A text's spans are one row; its matches are placed by a running sum, not held together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    every = [_matches(text, k, strict) for strict in (True, False) for k in range(len(KINDS))]
    # Written once: row numbers then stay what they are, and no text moves any further.
    found = scratch.write(rows.select("row", "id", F.concat(*every).alias("matches")), "found")
    spans = scratch.write(_unseen(spans_of(found.where(F.size("matches") > 0))), "spans")
    taken = bootstrap(spans, scratch, rounds)
    candidates = spans.where("NOT strict").join(taken, ["kind", "value"], "left_semi").select("row", "kind", "start", "end")
    early = W.partitionBy("row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    added = candidates.withColumn("reach", F.max("end").over(early)).where("reach IS NULL OR reach <= start").drop("reach")
    all_spans = spans.where("strict").select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added.withColumn("base", F.lit(False)))
    named = F.struct("kind", "start", "end")
    lists = all_spans.groupBy("row").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("base") == flag, named))).alias(name) for name, flag in (("base", True), ("added", False))])
    kind_name = F.array(*map(F.lit, KINDS))
    show = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")), lambda s: F.struct(
        F.element_at(kind_name, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = scratch.write(found.select("row", "id").join(lists, "row", "left").select(
        F.col("id").alias(id_col), show(F.col("base")).alias("base"), show(F.col("added")).alias("added")), "out")
    scratch.keep_only(out)
    return out


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by kind in the order of KINDS and then start."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", F.element_at(order, s["k"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")
