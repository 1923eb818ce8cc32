import zlib

import pytest

from spanforge.llm.line_dedup import dedup_lines
from spanforge.llm.queries import op7_line_windows


def brute(rows):
    """Rows (id, text) in order of reading: for each the text that stays and the lines removed."""
    seen, out = set(), {}
    for k, (doc_id, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        lines, gone = (text or "").split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(s.strip() for s in lines[i:i + 3])
            if any(w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out[k] = ("\n".join(s for i, s in enumerate(lines) if i not in gone) if gone else text, sorted(gone))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id").collect()
    want = brute([(d.doc_id, d.text) for d in docs])
    got = {r.doc_id: r for r in op7_line_windows(spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(docs) and sum(r.n_removed for r in got.values()) > 0
    for k, d in enumerate(docs):
        text, gone = want[k]
        assert got[d.doc_id].removed == ",".join(map(str, gone)) and got[d.doc_id].text_crc32 == zlib.crc32(text.encode())


def test_hostile_rows(spark):
    rows = [(None, None), (None, ""), (1, "a\nb\nc\nd\nx"), (2, "q\na \nb\nc\nd\ny"), (3, "\n\n\n\n"), (4, "a\nb"), (5, "a\na\na\na\na\na"),
            (6, "é\n\n\n"), (7, "é\n\n\n"), (8, "z\n" * 20000), (2, "q\na \nb\nc\nd\ny"), (None, "a\nb\nc")]
    df = spark.createDataFrame([(k, t, 0, "w") for k, t in rows], "doc_id long, text string, line int, windows string").coalesce(1)
    got = sorted((r.row, r.text, r.removed) for r in dedup_lines(df).collect())
    assert [(t, g) for _, t, g in got] == [brute(rows)[k] for k in range(len(rows))]
    assert dedup_lines(df.limit(0)).count() == 0
