"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under hashed letter triples, the declared markup
language, the country suffix of an address, and the host's prior. All tables are grouped counts over all documents.
The languages are the declared two-letter codes with at least LEAST_TEXTS texts, and their text models are counted from
those texts, the judged text left out. Beside them stands OTHER, under which every triple is equally likely: it wins where no model explains the
text better than chance (another language, codes, noise). What a declaration or suffix says is counted against what the
text alone suggests. A host's prior is its own counts, smoothed by those of its domain, which are smoothed by those of
all hosts (PRIOR rows' worth at each step); for OTHER it is UNSEEN at least. Letter triples are not independent, so a
text weighs no more than GRAMS of them; a short one weighs less. Triples without a letter say nothing of a language.

A document is accepted if it has at least LEAST_GRAMS triples and its best language reaches CONFIDENT, OTHER counted in.
Texts that are null, empty, without letters or best explained by OTHER have no language ("und") and are rejected. Rarer
or null declarations, suffixes and hosts are evidence values of their own. If no language is declared often enough,
all are rejected. Rows that repeat a key are judged alike; ties go to the first language by name. Empty tables give
empty results; other columns are kept by `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import mapped, saved, whole
from folioscan.llm.textstats import bodies

OTHER = "other"
CELLS, GRAMS, LEAST_GRAMS, CONFIDENT, PRIOR = 8192, 40, 1, 0.6, 20.0
LEAST_TEXTS, UNSEEN = 10, 0.01


def triples(text: bytes) -> np.ndarray:
    """Cells of all adjacent three-byte groups that hold a letter, ASCII letters in lower case, digits and blanks folded."""
    raw = FOLD[np.frombuffer(text, np.uint8)]
    if len(raw) < 3:
        return np.empty(0, np.int64)
    letter = LETTER[raw]
    return ((raw[:-2] * 7919 + raw[1:-1] * 311 + raw[2:] * 17) % CELLS)[letter[:-2] | letter[1:-1] | letter[2:]]


FOLD = np.arange(256, dtype=np.int64)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[list(b"\t\n\x0b\x0c\r")] = 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def observed(rows: DataFrame, key: str, text: Column, declared: Column, suffix: Column, host: Column) -> DataFrame:
    """The evidence of any table: key, text, declared, suffix (two letters or a class of its own), host, domain."""
    ending = F.lower(suffix)
    place = F.coalesce(F.lower(host), F.lit(""))
    known = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]{2})(?![A-Za-z])", 1))
    return rows.select(
        F.col(key).alias("key"), text.alias("text"),
        F.when(known == "", F.lit("none")).otherwise(known).alias("declared"),
        F.when(ending.rlike("^[a-z]{2}$"), ending).otherwise(F.lit("none")).alias("suffix"),
        place.alias("host"), F.substring_index(place, ".", -2).alias("domain"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents: the declared language, the last country suffix of an address in the text, and the source as host."""
    endings = F.regexp_extract_all(F.when(F.contains(F.col("text"), F.lit("@")), F.col("text")), F.lit(r"@[A-Za-z0-9.-]*\.([A-Za-z]{2})(?![A-Za-z0-9-])"), 1)
    last = F.when(F.size(endings) > 0, F.element_at(endings, -1))
    return observed(docs, "doc_id", whole("text"), F.col("lang"), last, F.col("source"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages: the markup's language, the host's suffix, the host."""
    html = whole("html")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    declared = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    return observed(pages, "page_id", text, declared, F.regexp_extract(host, r"\.([A-Za-z]+)$", 1), host)


def text_model(seen: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages by name, and smoothed counts of each cell per language, from all texts that declare one; OTHER is the last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}  # two-letter codes; the last cell counts the texts
        for b in batches:
            for text, name in zip(bodies(b.column(0)), b.column(1).to_pylist()):
                cells = triples(text)
                if len(cells):
                    total.setdefault(name, np.zeros(CELLS + 1, np.int64))
                    total[name] += np.bincount(cells, minlength=CELLS + 1)
                    total[name][CELLS] += 1
        for name, n in total.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(n[cell])], ["lang", "cell", "n"])

    parts = mapped(seen.filter("declared <> 'none'").select("text", "declared"), run, "lang string, cell int, n long")
    table = saved(parts.groupBy("lang", "cell").agg(F.sum("n").alias("n")), "language-cells")
    names = sorted(r["lang"] for r in table.filter((F.col("cell") == CELLS) & (F.col("n") >= LEAST_TEXTS)).collect())
    known = table.filter(F.col("lang").isin(names) & (F.col("cell") < CELLS)).toPandas()  # languages x cells at most
    counts = np.full((len(names) + 1, CELLS), 0.5)
    place = {x: i for i, x in enumerate(names)}
    np.add.at(counts, (known["lang"].map(place).to_numpy(int), known["cell"].to_numpy(int)), known["n"].to_numpy(float))
    counts[-1] = 1.0
    return names, counts


def text_evidence(seen: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """Adds grams (number of triples), the log-likelihoods under the model's rows, and what the text alone suggests; drops the text.

    A text's own triples are taken out of the language that it was counted for, so that no text vouches for itself.
    """
    rest = ["key", "declared", "suffix", "host", "domain"]
    every = [*names, OTHER]
    place = {x: i for i, x in enumerate(names)}
    sums = model.sum(1)
    logs = np.log(model / sums[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.zeros((b.num_rows, len(every)))
            grams = np.zeros(b.num_rows, np.int64)
            for i, (text, name) in enumerate(zip(bodies(b.column(0)), b.column(2).to_pylist())):
                cells = triples(text)
                grams[i] = len(cells)
                if len(cells):
                    table[i] = logs[:, cells].mean(1)
                    if name in place:
                        own = place[name]
                        rest_of = model[own, cells] - np.bincount(cells, minlength=CELLS)[cells]
                        table[i, own] = np.log(rest_of / (sums[own] - len(cells))).mean()
                    table[i] *= min(len(cells), GRAMS)
            guess = [every[i] if n >= LEAST_GRAMS else None for i, n in zip(table.argmax(1), grams)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(grams), pa.array(list(table), pa.list_(pa.float64())), pa.array(guess, pa.string())], [*rest, "grams", "told", "guess"]
            )

    key = seen.schema["key"].dataType.simpleString()
    spec = f"key {key}, declared string, suffix string, host string, domain string, grams long, told array<double>, guess string"
    declared = F.when(F.col("declared").isin([*names, "none"]), F.col("declared")).otherwise(F.lit(OTHER))
    return mapped(seen.withColumn("declared", declared).select("text", *rest), run, spec)


def told(rows: DataFrame, column: str, every: list[str]) -> dict[str, np.ndarray]:
    """Per value of a small alphabet: the log chance of that value in a text of each language."""
    seen = rows.filter("guess is not null").groupBy("guess", column).count().collect()
    values = sorted({r[column] for r in seen})
    each = {x: sum(r["count"] for r in seen if r["guess"] == x) for x in every}
    n = {(r["guess"], r[column]): r["count"] for r in seen}
    return {v: np.log([(n.get((x, v), 0) + 1) / (each[x] + len(values) + 1) for x in every]) for v in values}


def host_priors(rows: DataFrame, every: list[str]) -> DataFrame:
    """host and its log priors."""
    seen = rows.filter("guess is not null")
    sums = [F.count(F.when(F.col("guess") == x, 1)).cast("double").alias(x) for x in every]
    hosts = saved(seen.groupBy("host", "domain").agg(*sums), "host-counts")
    domains = hosts.groupBy("domain").agg(*[F.sum(x).alias(f"d_{x}") for x in every])
    n = hosts.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in every]).first()
    share = {x: (n[i] + 1) / (sum(n) + len(every)) for i, x in enumerate(every)}
    of_domain = sum((F.col(f"d_{x}") for x in every), F.lit(0.0))
    of_host = sum((F.col(x) for x in every), F.lit(0.0))
    upper = {x: (F.col(f"d_{x}") + PRIOR * share[x]) / (of_domain + PRIOR) for x in every}
    prior = {x: (F.col(x) + PRIOR * upper[x]) / (of_host + PRIOR) for x in every}
    prior[OTHER] = F.greatest(prior[OTHER], F.lit(UNSEEN))
    return hosts.join(domains, "domain").select("host", F.array(*[F.log(prior[x]) for x in every]).alias("prior"))


def identified(seen: DataFrame) -> DataFrame:
    """One row per row of evidence: key, lang, confidence, kept, text_lang."""
    names, model = text_model(seen)
    every = [*names, OTHER]
    rows = saved(text_evidence(seen, names, model), "language-evidence")
    declared, suffix = told(rows, "declared", every), told(rows, "suffix", every)
    priors = saved(host_priors(rows, every), "host-priors")
    joined = rows.join(priors, "host", "left").select("key", "grams", "told", "prior", "declared", "suffix", "guess")
    nothing = np.zeros(len(every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, grams, text, prior, tag, end, guess = (c.to_pylist() for c in b.columns)
            lang, sure = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for i, n in enumerate(grams):
                if n >= LEAST_GRAMS:
                    score = np.array(text[i]) + declared.get(tag[i], nothing) + suffix.get(end[i], nothing) + (nothing if prior[i] is None else prior[i])
                    best = int(score.argmax())
                    if best < len(names):
                        lang[i], sure[i] = names[best], 1 / np.exp(score - score[best]).sum()
            alone = ["und" if g is None or g == OTHER else g for g in guess]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(sure), pa.array(sure >= CONFIDENT), pa.array(alone, pa.string())],
                ["key", "lang", "confidence", "kept", "text_lang"],
            )

    key = seen.schema["key"].dataType.simpleString()
    return mapped(joined, run, f"key {key}, lang string, confidence double, kept boolean, text_lang string")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is certain enough, all columns."""
    gone = saved(identified(of_documents(docs)).filter("not kept").select(F.col("key").alias("_gone")).distinct(), "no-language")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
