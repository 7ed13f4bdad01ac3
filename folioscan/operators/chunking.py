"""Chunkers: greedy packers and windows as ordered folds over the pieces of one row's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import html, ids
from folioscan.functions.text import let, sentences, slug, strip, token_estimate, words
from folioscan.operators import sections

# fixed values: chunk sizes in characters, tokens and words
SIZE, LOOK_BACK, MIN_SIZE = 1000, 200, 100
MAX_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 512, 256, 4
WORD_WINDOW, WORD_OVERLAP = 1000, 150
PACK = "struct<out:array<string>,cur:string>"


def _zero() -> Column:
    return F.struct(F.array(), F.lit("")).cast(PACK)


def _state(out: Column, cur: Column) -> Column:
    return F.struct(out.alias("out"), cur.alias("cur")).cast(PACK)


def _add(out: Column, piece: Column) -> Column:
    return F.concat(out, F.array(piece))


def _flush(acc: Column) -> Column:
    return F.when(strip(acc["cur"]) != "", _add(acc["out"], strip(acc["cur"]))).otherwise(acc["out"])


def _glue(cur: Column, sep: str, piece: Column) -> Column:
    return F.when(cur == "", piece).otherwise(F.concat(cur, F.lit(sep), piece))


def pack_block(block: Column, limit: int = SIZE) -> Column:
    """Greedy paragraphs of one Markdown section; a full buffer is flushed unless it is blank."""

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > limit) & (strip(acc["cur"]) != "")
        cur = F.when(full, F.lit("")).otherwise(acc["cur"])
        return _state(F.when(full, _add(acc["out"], strip(acc["cur"]))).otherwise(acc["out"]), _glue(cur, "\n\n", p))

    return F.aggregate(F.split(block, r"\n\s*\n"), _zero(), step, _flush)


def pack_paragraphs(body: Column, limit: int = SIZE) -> Column:
    """Greedy blank-line separated paragraphs of a plain text."""

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > limit) & (acc["cur"] != "")
        return _state(
            F.when(full, _add(acc["out"], strip(acc["cur"]))).otherwise(acc["out"]),
            F.when(full, p).otherwise(_glue(acc["cur"], "\n\n", p)),
        )

    return F.aggregate(F.split(body, "\n\n"), _zero(), step, _flush)


def pack_sentences(body: Column, limit: int, overlap: int) -> Column:
    """Greedy sentences; a new chunk starts with the whole sentences in the last `overlap` characters.

    The open chunk is `head` and the sentences since `first`, with its length in `n`; its text is put together only when it is full.
    """
    shape = "struct<out:array<string>,head:string,first:int,at:int,n:int>"

    def state(out: Column, head: Column, first: Column, at: Column, n: Column) -> Column:
        return F.struct(out.alias("out"), head.alias("head"), first.alias("first"), at.alias("at"), n.alias("n")).cast(shape)

    def pack(every: Column) -> Column:
        text = lambda acc: F.concat(acc["head"], F.array_join(F.slice(every, acc["first"] + 1, acc["at"] - acc["first"]), " "))

        def step(acc: Column, s: Column) -> Column:
            out, at, n = acc["out"], acc["at"], acc["n"]

            def opened(head: Column) -> Column:
                return state(_add(out, strip(text(acc))), head, at, at + 1, F.length(head) + F.length(s))

            def carried(tail: Column) -> Column:
                rest = F.concat(F.array_join(F.slice(tail, F.lit(2), F.size(tail)), " "), F.lit(" "))
                return F.when(F.size(tail) > 1, rest).otherwise("")

            none = F.lit("")
            head = F.when(n > overlap, let(sentences(F.substring(text(acc), -overlap, overlap)), carried)).otherwise(none) if overlap > 0 else none
            # one branch per case, so that each part of it is computed once
            return (
                F.when(n == 0, state(out, none, at, at + 1, F.length(s)))
                .when(n + F.length(s) > limit, let(head, opened))
                .otherwise(state(out, acc["head"], acc["first"], at + 1, n + 1 + F.length(s)))
            )

        def finish(acc: Column) -> Column:
            return let(strip(text(acc)), lambda cur: F.when(cur != "", _add(acc["out"], cur)).otherwise(acc["out"]))

        zero = F.struct(F.array(), F.lit(""), F.lit(0), F.lit(0), F.lit(0)).cast(shape)
        return F.aggregate(every, zero, step, finish)

    return let(sentences(body), pack)


def size_windows(body: Column, size: int = SIZE, overlap: int = 0, min_size: int = MIN_SIZE) -> Column:
    """Windows of `size` characters that end after the last sentence end in their final LOOK_BACK characters.

    overlap 0 starts the next window where the last one ended; a positive overlap steps back by that much.
    Windows shorter than min_size are dropped; a text that fits one window is returned unchanged.
    A window is read from the blocks that hold it, never counted from the start of the text, so long texts stay linear.
    """
    if not 0 <= overlap < size - LOOK_BACK:
        raise ValueError(f"overlap must be at least 0 and under {size - LOOK_BACK}")
    shape = "struct<start:int,out:array<string>>"
    per_window = -(-size // LOOK_BACK) + 1

    def windows(held: Column) -> Column:
        blocks, n = held["blocks"], held["n"]
        turns = F.sequence(F.lit(0), F.floor(n / (size - LOOK_BACK - overlap)).cast("int") + 1)

        def step(acc: Column, _turn: Column) -> Column:
            start = acc["start"]

            def window(w: Column) -> Column:
                back = F.length(F.regexp_extract(F.substring(w, size - LOOK_BACK + 1, LOOK_BACK), r"(?s)^(.*[.!?]\s+)", 1))
                taken = F.when(start + size < n, let(back, lambda b: F.when(b > 0, b + size - LOOK_BACK).otherwise(size))).otherwise(size)
                return let(taken, lambda t: let(strip(F.substring(w, F.lit(1), t)), lambda piece: following(start + t, piece)))

            def following(end: Column, piece: Column) -> Column:
                out = F.when(F.length(piece) >= min_size, _add(acc["out"], piece)).otherwise(acc["out"])
                return F.struct(F.when(end >= n, end).otherwise(end - overlap).alias("start"), out.alias("out")).cast(shape)

            near = F.array_join(F.slice(blocks, F.floor(start / LOOK_BACK).cast("int") + 1, F.lit(per_window)), "")
            return F.when(start >= n, acc).otherwise(let(F.substring(near, start % LOOK_BACK + 1, F.lit(size)), window))

        return F.aggregate(turns, F.struct(F.lit(0), F.array()).cast(shape), step, lambda acc: acc["out"])

    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{LOOK_BACK}}}"), F.lit(0))
    cut = let(F.struct(blocks.alias("blocks"), F.length(body).alias("n")), windows)
    return F.when(F.length(body) <= size, F.array(body)).otherwise(cut)


def word_windows(body: Column, window: int = WORD_WINDOW, overlap: int = WORD_OVERLAP, limit: int = SIZE) -> Column:
    """The text itself when it has at most `limit` characters, else overlapping windows of words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(window - overlap))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(window)), " "))

    return F.when(F.length(body) <= limit, F.array(body)).otherwise(let(words(body), cut))


def h2_chunks(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, section, part, heading, anchor, content): sections at level two or deeper, greedily packed.

    Text before the first such heading is one chunk called Introduction, whatever its size.
    """
    marked = F.regexp_replace(F.col(body), r"(?m)^##+\s+(.*)$", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    split = docs.select(key, F.posexplode(parts).alias("section", "p"))
    pre = F.col("section") == 0
    heading = F.when(pre, F.lit("Introduction")).otherwise(strip(F.split_part("p", F.lit("\u0002"), F.lit(1))))
    block = F.when(pre, strip(F.col("p"))).otherwise(strip(F.split_part("p", F.lit("\u0002"), F.lit(2))))
    chunks = F.when(pre, F.filter(F.array(block), lambda b: b != "")).otherwise(pack_block(block))
    return split.select(key, "section", heading.alias("heading"), F.posexplode(chunks).alias("part", "content")).select(
        key, "section", "part", "heading", slug(F.col("heading")).alias("anchor"), "content"
    )


def _heading_pieces(body: str, limit: int, overlap: int) -> Column:
    """array<struct<h_path,content>> of a row prepared by sections.with_headings."""
    last = F.size("_heads")
    text = F.col(body)
    starts = F.concat(F.array(F.lit(0)), F.transform("_heads", lambda h: h["offset"]))

    def section(at: Column, i: Column) -> Column:
        end = F.when(i < last, F.get(F.col("_heads"), i)["offset"]).otherwise(F.length(text))
        path = F.when(i == 0, sections.empty_strings()).otherwise(F.get(F.col("_paths"), i - 1))
        split = lambda c: F.when(F.length(c) <= limit, F.array(c)).otherwise(pack_sentences(c, limit, overlap))
        pieces = let(strip(F.substring(text, at + 1, end - at)), split)
        return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(path.alias("h_path"), p.alias("content")))

    return F.flatten(F.transform(starts, section))


def heading_chunks(
    docs: DataFrame, key: str, body: str,
    limit: int = MAX_TOKENS * CHARS_PER_TOKEN, overlap: int = OVERLAP_TOKENS * CHARS_PER_TOKEN,
) -> DataFrame:
    """(key, chunk_index, chunk_id, h_path, content): one chunk per heading section with its heading line,
    oversize sections split by sentences with overlap. Text before the first heading is kept."""
    d = sections.with_headings(docs, body, fill_gaps=True, stripped=True)
    pieces = F.posexplode(_heading_pieces(body, limit, overlap)).alias("chunk_index", "c")
    out = d.select(key, pieces).select(key, "chunk_index", "c.h_path", "c.content")
    return out.withColumn("chunk_id", ids.stable_chunk_id(F.col(key).cast("string"), F.col("h_path"), F.col("chunk_index")))


def _with_heading(heading: Column, content: Column) -> Column:
    return F.when(heading.isNull(), content).otherwise(F.concat(heading, F.lit("\n\n"), content))


def html_chunks(pages: DataFrame, key: str, page: str, size: int = SIZE) -> DataFrame:
    """(key, section, part, total_parts, heading, level, content) of heading-aware page chunks."""
    s = sections.html_sections(pages, key, page)
    cut = s.withColumn("_w", _with_heading(F.col("heading"), F.col("content")))
    cut = cut.withColumn("_pieces", size_windows(F.col("_w"), size))
    return cut.select(
        key, F.col("pos").alias("section"), "heading", "level", F.size("_pieces").alias("total_parts"),
        F.posexplode("_pieces").alias("part", "content"),
    )


def content_kind(body: Column) -> Column:
    """markdown when there is an ATX heading line, else html when there is any tag, else text."""
    # a plain search for the one character that each pattern needs spares most texts the patterns
    return (
        F.when(F.contains(body, F.lit("#")) & body.rlike(r"(?m)^#{1,6}\s+.+$"), "markdown")
        .when(F.contains(body, F.lit("<")) & (body.rlike(r"(?i)<html|<body") | body.rlike(r"<[^>]+>")), "html")
        .otherwise("text")
    )


def chunk_documents(
    docs: DataFrame, heading_aware: bool = True, min_size: int = MIN_SIZE,
    chunker_version: str = "v1.0.0", model: str = "sentence-transformers/all-MiniLM-L6-v2", model_version: str = "v1.0.0",
) -> DataFrame:
    """Chunk documents(url, title, source_name, content) by content kind in one pass without an exchange.

    Short chunks are dropped and leave gaps in chunk_index.
    """
    d = docs.filter(F.col("content") != "").withColumn("document_id", ids.url_id(F.col("url"))).withColumn(
        "kind", content_kind(F.col("content"))
    )
    markdown = (F.col("kind") == "markdown") & heading_aware
    web = (F.col("kind") == "html") & heading_aware
    clean = F.when(F.col("kind") == "html", html.visible_text(F.col("content"))).otherwise(F.col("content"))
    d = d.withColumns(
        {
            "_md": F.when(markdown, F.col("content")),
            "_web": F.when(web, sections.html_section_array(F.col("content"))),
            "_plain": F.when(~markdown & ~web, clean),
        }
    )
    d = sections.with_headings(d, "_md", fill_gaps=True, stripped=True)
    none = F.lit(None).cast("string")

    def piece(path: Column, heading: Column, level: Column, content: Column) -> Column:
        return F.struct(
            path.alias("h_path"), heading.alias("heading"), level.cast("int").alias("heading_level"), content.alias("content")
        )

    no_path = sections.empty_strings()
    from_md = F.transform(
        _heading_pieces("_md", MAX_TOKENS * CHARS_PER_TOKEN, OVERLAP_TOKENS * CHARS_PER_TOKEN),
        lambda p: piece(p["h_path"], F.try_element_at(p["h_path"], F.lit(-1)), F.nullif(F.size(p["h_path"]), F.lit(0)), p["content"]),
    )
    from_web = F.flatten(
        F.transform(
            "_web",
            lambda s: F.transform(
                let(_with_heading(s["heading"], s["content"]), lambda w: size_windows(w)),
                lambda c: piece(no_path, s["heading"], s["level"], c),
            ),
        )
    )
    from_plain = F.transform(size_windows(F.col("_plain")), lambda c: piece(no_path, none, F.lit(None), c))
    pieces = F.when(markdown, from_md).when(web, from_web).otherwise(from_plain)
    chunks = d.select("document_id", "url", "title", "source_name", "kind", F.posexplode(pieces).alias("chunk_index", "p"))
    chunks = chunks.select("document_id", "url", "title", "source_name", "kind", "chunk_index", "p.*")
    stable = ids.stable_chunk_id(F.col("document_id"), F.col("h_path"), F.col("chunk_index"))
    return (
        chunks.filter(F.length("content") >= min_size)
        .withColumn("chunk_id", F.when(markdown, stable).otherwise(ids.numbered_chunk_id(F.col("document_id"), F.col("chunk_index"))))
        .withColumn("content_hash", ids.content_hash(F.col("content")))
        .withColumn("token_count", token_estimate(F.col("content")))
        .withColumn("chunker_version", F.lit(chunker_version)).withColumn("embedding_model", F.lit(model))
        .withColumn("lineage_id", ids.run_lineage_id(F.lit(chunker_version), F.lit(model), F.lit(model_version)))
    )
