"""Sections by a table of titles, parents and children on small literal inputs."""

from corpusmill.operators import sections

TOC = "doc_id long, ord int, page int, page_start int, page_end int, level int, title string"


def made(spark, text, toc, doc=1):
    docs = spark.createDataFrame([(doc, text)], "doc_id long, text string")
    marked = sections.with_marks(docs, spark.createDataFrame([(doc, i, *e) for i, e in enumerate(toc)], TOC))
    return sections.with_sections(marked)


def spans(df):
    return [(s.start, s.end, s.level, list(s.path), s.words) for s in df.first().sections]


def test_titles_in_their_order(spark):
    text = "front\nCHAPTER 2 The  Writer's\nWay\nbody one\nthe writer’s way\nbody two\nLast (part)\nend"
    second, third = text.index("the writer’s"), text.index("Last")
    toc = [(1, 0, len(text), 1, "Chapter 2. The writer’s way"), (1, 0, len(text), 2, "The Writer's Way"), (1, 0, len(text), 2, "not there"), (1, 0, len(text), 3, "Last (part)"), (None, None, None, 1, "no page")]
    assert spans(made(spark, text, toc)) == [
        (0, 6, 1, [sections.BODY], 1), (6, second, 1, ["Chapter 2. The writer’s way"], 7), (second, third, 2, ["Chapter 2. The writer’s way", "The Writer's Way"], 5), (third, len(text), 3, ["Chapter 2. The writer’s way", "The Writer's Way", "Last (part)"], 3),
    ]


def test_titles_not_found_stand_at_their_page(spark):
    text = "aaa bbb\nccc ddd\neee Titel\nfff"
    assert [s[:2] for s in spans(made(spark, text, [(1, 0, 8, 1, "x y"), (2, 12, 30, 1, "Titel"), (2, 12, 30, 1, None), (3, 26, 30, 2, "")]))] == [(0, 12), (12, 26), (26, 29)]
    assert spans(made(spark, text, [])) == [(0, len(text), 1, [sections.BODY], 7)]
    assert made(spark, None, [(1, 0, 5, 1, "x")]).first().sections == []


def test_short_sections_join_but_not_over_chapters(spark):
    text = "".join(f"T{i}\n" + "word " * n + "\n" for i, n in enumerate([3, 3, 200, 3, 3]))
    toc = [(i, text.index(f"T{i}"), len(text), level, f"T{i}") for i, level in enumerate([1, 3, 3, 1, 3])]
    rows = sections.merged(made(spark, text, toc), 120)
    assert [(s[2], s[3][-1], s[4]) for s in spans(rows)] == [(3, "T2", 209), (3, "T4", 8)]


def test_children_lie_in_parents(spark):
    text = "Intro words here.\n\nBig One\n" + " ".join(f"Sentence number {i} has some words in it." for i in range(300)) + "\nSmall\nfew words"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    toc = spark.createDataFrame([(1, 1, 1, 0, len(text), 1, "Big One"), (1, 2, 1, 0, len(text), 2, "Small")], TOC)
    rows = sections.parents_and_children(docs, toc).orderBy("doc_id", "chunk").collect()
    assert {r.doc_id for r in rows} == {1} and [r.chunk for r in rows] == list(range(len(rows)))
    parents = {(r.parent, r.parent_start, r.parent_end, r.section) for r in rows}
    assert len(parents) == len({p[0] for p in parents}) >= 5
    for r in rows:
        assert r.parent_start <= r.start < r.end <= r.parent_end and text[r.start : r.end] == r.text and len(r.text.split()) <= 120
        assert len(text[r.parent_start : r.parent_end].split()) <= 600
    assert {p[3] for p in parents} == {sections.BODY, "Big One", "Big One > Small"}
