import re
import time

import pytest
from pyspark.sql import functions as F

from folioscan.operators import chunking, sections


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")


def cut(spark, body, **kw):
    return docs(spark, body).select(chunking.size_windows(F.col("body"), **kw).alias("c")).first().c


def brute_windows(text, size=1000, overlap=0, least=100):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            stops = [m.end() for m in re.finditer(r"[.!?]\s+", text[end - 200:end])]
            if stops:
                end = end - 200 + stops[-1]
        piece = text[start:end].strip()
        if len(piece) >= least:
            out.append(piece)
        start = end if end >= len(text) else end - overlap
    return out


@pytest.mark.parametrize("overlap", [0, 200])
def test_size_windows(spark, overlap):
    words = " ".join(f"word{i}{'.' if i % 13 == 0 else ''}" for i in range(900))
    for body in ["A" * 2500, "A" * 1500, "Short text", "x" * 1000, words, "é. " * 700]:
        assert cut(spark, body, overlap=overlap) == brute_windows(body, overlap=overlap)


def test_windows_cover_the_text(spark):
    body = " ".join(f"Sentence number {i}." for i in range(400))
    assert "".join("".join(cut(spark, body)).split()) == "".join(body.split())


def test_sentence_packing_overlap(spark):
    body = " ".join(f"This is sentence {i}." for i in range(60))
    c = docs(spark, body).select(chunking.pack_sentences(F.col("body"), 200, 60).alias("c")).first().c
    assert len(c) > 3
    for before, after in zip(c, c[1:]):
        shared = after.split(". ")[0] + "."
        assert shared in before  # starts with a whole sentence of the chunk before
    assert set(re.findall(r"sentence (\d+)", " ".join(c))) == {str(i) for i in range(60)}


def test_h2_chunks(spark):
    body = "intro\n\n# Top\n\n## A b!\n\n" + "\n\n".join("p" * 400 for _ in range(4)) + "\n### Deep\ntext\n## Empty\n"
    rows = chunking.h2_chunks(docs(spark, body), "doc_id", "body").orderBy("section", "part").collect()
    assert [(r.heading, r.anchor) for r in rows] == [
        ("Introduction", "introduction"), ("A b!", "a-b"), ("A b!", "a-b"), ("Deep", "deep"),
    ]
    assert len(rows[1].content) == 802 and len(rows[2].content) == 802


def test_heading_paths_fill_and_close(spark):
    body = "pre\n### Three\nx\n# One\ny\n### Gap\nz\n####### seven\nw"
    c = chunking.heading_chunks(docs(spark, body), "doc_id", "body").orderBy("chunk_index").collect()
    assert [r.h_path for r in c] == [[], ["", "", "Three"], ["One"], ["One", "", "Gap"]]
    assert c[0].content == "pre" and c[3].content == "### Gap\nz\n####### seven\nw"
    s = sections.body_sections(docs(spark, body), "doc_id", F.lit("u"), "body").orderBy("start_pos").collect()
    assert [(r.heading, r.path) for r in s] == [
        ("Document Root", ""), ("Three", "Three"), ("One", "One"), ("Gap", "One > Gap"),
    ]
    assert [body[r.start_pos:r.end_pos].strip() for r in s] == [r.content for r in s]


def test_stable_ids_and_empty_text(spark):
    body = "# H\ntext here"
    ids = lambda: [r.chunk_id for r in chunking.heading_chunks(docs(spark, body), "doc_id", "body").collect()]
    assert ids() == ids()
    assert chunking.heading_chunks(docs(spark, ""), "doc_id", "body").count() == 0
    assert chunking.h2_chunks(docs(spark, " \n "), "doc_id", "body").count() == 0


def test_html_sections(spark):
    page = "<body><p>before</p><script>var x='<p>no</p>'</script><h1>T &amp; U</h1><ul><li>menu</li></ul><p>one<p>two <b>bold</b></p><h2></h2><div>three</div>tail</body>"
    rows = sections.html_sections(docs(spark, page), "doc_id", "body").orderBy("pos").collect()
    assert [(r.heading, r.level, r.content) for r in rows] == [(None, None, "before"), ("T & U", 1, "one two bold"), ("", 2, "three")]


def test_router_and_index_gaps(spark):
    md = "tiny\n# Head\n" + "word " * 60
    rows = [("u1", "t", "s", md), ("u2", "t", "s", "<p>" + "long enough text " * 10 + "</p>"), ("u3", "t", "s", "plain " * 50), ("u4", "t", "s", "")]
    df = spark.createDataFrame(rows, "url string, title string, source_name string, content string")
    got = {r.url: r for r in chunking.chunk_documents(df).collect()}
    assert {u: r.kind for u, r in got.items()} == {"u1": "markdown", "u2": "html", "u3": "text"}
    assert got["u1"].chunk_index == 1 and got["u1"].heading == "Head" and len(got["u1"].chunk_id) == 12
    assert got["u3"].chunk_id == got["u3"].document_id + "_0000"
    assert got["u2"].token_count == len(got["u2"].content) // 4
    assert chunking.chunk_documents(df, heading_aware=False).count() == 3


def test_word_windows(spark):
    body = " ".join(f"w{i}" for i in range(2000))
    c = docs(spark, body).select(chunking.word_windows(F.col("body")).alias("c")).first().c
    assert [x.split()[0] for x in c] == ["w0", "w850", "w1700"] and len(c[0].split()) == 1000


def brute_packed(text, limit, overlap):
    """The greedy rule over whole strings: the open chunk is measured and cut as text."""
    cut = lambda t: re.split(r"(?<=[.!?])\s+", t)
    out, cur = [], ""
    for s in cut(text):
        if cur and len(cur) + len(s) > limit:
            out.append(cur.strip(" \t\n\f\r"))
            tail = cut(cur[-overlap:])
            cur = " ".join(tail[1:]) + " " + s if len(cur) > overlap and len(tail) > 1 else s
        else:
            cur = cur + " " + s if cur else s
    return out + [cur.strip(" \t\n\f\r")] * bool(cur.strip(" \t\n\f\r"))


def test_packed_sentences_equal_the_rule_on_strings(spark):
    even = " ".join(f"Satz {i} ist é lang{'!' if i % 7 else '.'}" for i in range(300))
    texts = [even, "", "  ", "One. ", ". . . ! ? " * 90, "x" * 900 + ". " + "y" * 700, "A.\n\n B?  C! " * 80, " lead. " * 60, ("w" * 59 + ". ") * 40]
    for limit, overlap in ((200, 60), (600, 200)):
        got = docs(spark, *texts).select("doc_id", chunking.pack_sentences(F.col("body"), limit, overlap).alias("c")).collect()
        assert {r.doc_id: r.c for r in got} == {i: brute_packed(t, limit, overlap) for i, t in enumerate(texts)}


def test_long_text_is_cut_in_linear_time(spark):
    """Windows that were counted from the start of the text took quadratic time."""
    body = "A sentence of some forty characters, no. " * 50000
    cut(spark, body[:5000])
    begun = time.time()
    pieces = cut(spark, body)
    assert time.time() - begun < 20
    assert sum(len("".join(p.split())) for p in pieces) == len("".join(body.split()))
