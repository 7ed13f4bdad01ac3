"""Personal data: fixed patterns, and terms that give protected entities away, all in column expressions.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Protected entities are their values and
what these have in common with others: an address's local part and domain, a network's first two and three numbers, a card's
issuer, a number's prefix, and the kind itself. Terms are the words (runs of letters) of a document outside of addresses.

The corpus says how strongly a term reveals an entity: with N documents, n(e) of them holding the entity, n(t) the term
and n(t, e) both, anywhere in the document, the pointwise mutual information log(N n(t, e) / (n(t) n(e))) is the part of
the entity's information log(N / n(e)) that the term discloses. What rests on few texts is discounted smoothly, by
1 - DISCOUNT / k^2 for k different texts that hold both. A term that discloses GENERALISE of some entity's information is
generalised, from REMOVE on removed: every occurrence, in whatever document. Counts cover all documents; entities and
terms of a single text are left out of the pairs only because their discounted share can't reach GENERALISE.

A span is kind:start:end in code points, the end exclusive; spans are joined by start and then by kind in the order of
KINDS. Null and empty texts have none. Rows that repeat a doc_id have the same spans and count singly. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import let
from folioscan.llm.common import saved, whole

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
DISCOUNT, GENERALISE, REMOVE = 0.75, 0.8, 0.95
#: Flagged terms are sent to all tasks up to this many characters, and joined by shuffle beyond.
SENT_CHARACTERS = 8_000_000
#: Maximal runs are taken possessively, and a search starts at a run's first character or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}+"
FOUND = "struct<start:int,stop:int,value:string>"


def running(numbers: Column) -> Column:
    """Running sums. They are built in stretches of the root of their number, as appending to one array would be quadratic."""
    grown = lambda part, first: F.aggregate(part, F.array(first.cast("int")), lambda sums, n: F.concat(sums, F.array((F.element_at(sums, -1) + n).cast("int"))))

    def stretches(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, n: (s + n).cast("int")))
        return let(grown(totals, F.lit(0)), lambda firsts: F.flatten(F.zip_with(parts, F.slice(firsts, 1, F.size(parts)), lambda p, first: F.slice(grown(p, first), 2, F.size(p)))))

    def cut(whole: Column) -> Column:
        root = F.ceil(F.sqrt(F.size(whole))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), root - 1), lambda k: F.slice(whole, k * root + 1, root))
        return F.when(F.size(whole) > 0, let(F.filter(parts, lambda p: F.size(p) > 0), stretches)).otherwise(F.array().cast("array<int>"))

    return let(numbers, cut)


def located(text: Column, pattern: str) -> Column:
    """Matches with their places: a match is paired with what stands before it, and the lengths of both are added up."""
    pairs = F.zip_with(
        F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")),
    )

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda d: d["gap"] + F.length(d["value"])))
        return F.zip_with(found, ends, lambda d, stop: F.struct((stop - F.length(d["value"])).alias("start"), stop.alias("stop"), d["value"].alias("value")))

    # The piece after the last match has no partner.
    return let(F.filter(pairs, lambda d: d["value"].isNotNull()), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right is doubled, nine taken off above nine; the sum ends in 0."""
    d = F.reverse(digits(value))

    def add(acc: Column, i: Column) -> Column:
        n = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def of_kind(kind: int):
    return lambda d: F.struct(d["start"].alias("start"), F.lit(kind).alias("kind"), d["stop"].alias("stop"), d["value"].alias("value"))


def is_kind(kind: int):
    return lambda d: d["kind"] == kind


def base_spans(text: Column) -> Column:
    """All base spans as one array of structs (start, kind, stop, value), sorted."""
    none = F.expr(f"cast(array() as array<{FOUND}>)")
    size = lambda d: F.length(digits(d["value"]))
    numbers = text.rlike("[0-9]")
    rules = (
        (F.contains(text, F.lit("@")), EMAIL, lambda d: F.lit(True)),
        (numbers, IP, lambda d: d["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        (numbers, CARD, lambda d: F.when(size(d).between(14, 19), luhn(d["value"])).otherwise(F.lit(False))),
        (F.contains(text, F.lit("+")), PHONE, lambda d: size(d).between(10, 15)),
    )
    every = []
    for kind, (gate, pattern, passes) in enumerate(rules):
        spans = F.filter(F.when(gate, located(text, pattern)).otherwise(none), passes)
        every.append(F.transform(spans, of_kind(kind)))
    return F.array_sort(F.concat(*every))


def entities(d: Column) -> Column:
    """The protected entities of one base span, finest first."""
    value, number = F.lower(d["value"]), digits(d["value"])
    named = lambda **parts: F.array(*[F.concat(F.lit(f"{k}:"), v) for k, v in parts.items()])
    return (
        F.when(d["kind"] == 0, named(email=value, local=F.substring_index(value, "@", 1), domain=F.substring_index(value, "@", -1), kind=F.lit("email")))
        .when(d["kind"] == 1, named(ip=value, net3=F.substring_index(value, ".", 3), net2=F.substring_index(value, ".", 2), kind=F.lit("ip")))
        .when(d["kind"] == 2, named(card=number, issuer=F.substring(number, 1, 6), kind=F.lit("card")))
        .otherwise(named(phone=number, prefix=F.substring(number, 1, 5), kind=F.lit("phone")))
    )


def terms(text: Column) -> Column:
    """The different words of a text outside of addresses; other base values hold no letters."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), base spans, and where there are any the document's entities and terms."""
    rows = docs.select("doc_id", whole("text").alias("text")).withColumn("spans", base_spans(F.col("text")))
    held = F.size("spans") > 0
    own = F.when(held, F.array_distinct(F.flatten(F.transform("spans", entities))))
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), "spans", own.alias("entities"), F.when(held, terms(F.col("text"))).alias("terms"))


def disclosing(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """term and kind of the terms over the thresholds, each by the entity that it discloses most."""
    held = rows.filter("entities is not null").select(F.monotonically_increasing_id().alias("row"), "mark", "entities", "terms")
    held = saved(held, "private-held")
    each = held.select("row", "mark", F.explode("entities").alias("entity"))
    sums = lambda df, *keys: df.groupBy(*keys, "mark").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("texts"))
    known = saved(sums(each, "entity").filter("texts > 1").select("entity", F.col("docs").alias("n_entity")), "private-entities")
    words = held.select("row", F.explode("terms").alias("term"))
    often = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("term")
    telling = each.join(known.select("entity"), "entity")
    pairs = telling.join(words.join(often, "term"), "row")
    pairs = saved(sums(pairs, "entity", "term").filter("texts > 1"), "private-pairs")
    # Each document counts a term once; counts are folded in the task that reads the text.
    wanted = pairs.select("term").distinct()
    everywhere = docs.select(F.explode(terms(whole("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = F.lit(float(rows.count()))
    table = pairs.join(known, "entity").join(everywhere.join(wanted, "term", "left_semi"), "term")
    told = F.log(total * F.col("docs") / (F.col("n_term") * F.col("n_entity"))) / F.log(total / F.col("n_entity"))
    # An entity in every document carries no information that could be disclosed.
    share = F.when(F.col("n_entity") < total, told * (1 - DISCOUNT / (F.col("texts") * F.col("texts")))).otherwise(F.lit(0.0))
    kind = F.when(F.col("share") >= REMOVE, F.lit(KINDS.index("remove"))).otherwise(F.lit(KINDS.index("generalise")))
    return table.groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= GENERALISE).select("term", kind.alias("kind"))


def marked(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """_id, _mark and extra: all occurrences of flagged terms, outside of addresses, by document.

    Places are worked out only in the documents that hold such a term.
    """
    sent = flagged.agg(F.coalesce(F.sum(F.length("term") + 16), F.lit(0))).first()[0]
    flagged = F.broadcast(flagged) if sent <= SENT_CHARACTERS else flagged
    rows = docs.select("doc_id", F.xxhash64(whole("text")).alias("mark"), whole("text").alias("text"))
    held = rows.select("doc_id", "mark", F.explode(terms(F.col("text"))).alias("term")).join(flagged, "term")
    own = F.map_from_entries(F.collect_set(F.struct("term", "kind")))  # flagged terms of one text
    holding = saved(held.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(own.alias("own")), "private-holding")
    size = holding.agg(F.coalesce(F.sum(F.size("own") * 32 + 24), F.lit(0))).first()[0]
    holding = F.broadcast(holding) if size <= SENT_CHARACTERS else holding
    rows = rows.join(holding, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    # Addresses are matched too, so that no word is found inside of one.
    words = F.transform(located(F.col("text"), f"{EMAIL}|{TERM}"), lambda w: F.struct(w["start"].alias("start"), F.try_element_at("own", F.lower(w["value"])).alias("kind"), w["stop"].alias("stop")))
    return rows.select("_id", "_mark", F.filter(words, lambda w: w["kind"].isNotNull()).alias("extra")).dropDuplicates(["_id", "_mark"])


def written(spans: Column) -> Column:
    """Sorted (start, kind, stop) structs as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda d: F.concat_ws(":", F.get(names, d["kind"]), d["start"], d["stop"])), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, mark, base (spans with values) and spans (start, kind, stop of all), per row."""
    rows = saved(scanned(docs), "private-base")
    flagged = saved(disclosing(docs, rows), "private-flagged")
    extra = marked(docs, flagged)
    joined = rows.join(saved(extra, "private-extra"), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["mark"] == F.col("_mark")), "left")
    plain = F.transform("spans", lambda d: F.struct(d["start"].alias("start"), d["kind"].alias("kind"), d["stop"].alias("stop")))
    every = F.when(F.col("extra").isNull(), plain).otherwise(F.array_sort(F.concat(plain, F.col("extra"))))
    return joined.select("doc_id", "mark", F.col("spans").alias("base"), every.alias("spans"))


def private_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = found_spans(docs)
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and the text with its spans replaced: base values and generalised terms by their kind, removed terms by nothing."""
    spans = found_spans(docs).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_mark"])
    rows = docs.select("doc_id", whole("text").alias("text"))
    rows = rows.join(spans, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")))
    names = F.array(*[F.lit(f"[{k.upper()}]" if k != "remove" else "") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, d["start"] - acc["at"])
        return F.when(d["start"] < acc["at"], F.struct(F.greatest(acc["at"], d["stop"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(d["stop"].alias("at"), F.concat(acc["out"], gap, F.get(names, d["kind"])).alias("out"))
        )

    text = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.when(F.size("_spans") > 0, text).otherwise(F.col("text")).alias("text"))
