"""What a task holds at once does not grow with its batch; what needs no shuffle has none."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from dossier_spark.operators import blockmax as M
from dossier_spark.operators import retrieval as R
from dossier_spark.plans.file_queries import pack_docx
from dossier_spark.sources import files as S


def test_search_takes_one_block_at_a_time():
    words, chunks, rows = 2000, 64, 200
    raw = lambda v: np.asarray(v, np.int32).tobytes()
    row = {"client_id": "c", "block": 0, "n": chunks, "total": 64, "path": [f"p{i}" for i in range(chunks)], "page": [None] * chunks, "chunk_no": list(range(chunks)), "dl": raw([1] * chunks), "at": raw(range(chunks + 1)), "term": raw(range(chunks)), "tf": raw([1] * chunks), "n_chunks": 64, "avgdl": 1.0, "idf": [{"term": i, "idf": 1.0} for i in range(words)]}
    fields = [(c, pa.binary()) for c in ("dl", "at", "term", "tf")] + [("client_id", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("total", pa.int64()), ("path", pa.list_(pa.string())), ("page", pa.list_(pa.int32())), ("chunk_no", pa.list_(pa.int32())), ("n_chunks", pa.int64()), ("avgdl", pa.float64()), ("idf", pa.list_(pa.struct([("term", pa.int32()), ("idf", pa.float64())])))]
    batch = pa.concat_tables([pa.Table.from_pylist([row], pa.schema(fields))] * rows).combine_chunks().to_batches()[0]
    q = M.Queries([7], [str(i) for i in range(words)], np.array([0, 2]), np.array([3, 5], np.int32), np.ones(2))
    tracemalloc.start()
    found = sum(b.num_rows for b in M.search(SimpleNamespace(value=q), None, 1.5, 0.75)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2 * rows and peak < 20e6, (found, peak)


def test_paragraphs_go_out_in_pieces():
    one = pack_docx(1, "\n".join(f"line {i}" for i in range(500)))
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(40)], "content": [one] * 39 + [b"broken"]})
    out = list(S.docx_rows(iter([batch])))
    assert max(b.num_rows for b in out) < S.PIECE_ROWS + 600 and sum(b.num_rows for b in out) == 39 * 501 + 1
    assert out[-1]["error"][-1].as_py() == "BadZipFile"


def test_terms_are_counted_in_place(spark):
    rows = [("c", "p", None, 0, "bb aa bb cc bb"), ("c", "p", None, 1, ""), ("c", "q", None, 0, None), ("d", "q", 1, 0, "zz a1 a1")]
    p = R.postings(R.chunk_tokens(spark.createDataFrame(rows, "client_id string, path string, page int, chunk_no int, chunk string")))
    assert sorted((r.client_id, r.chunk_no, r.term, r.tf) for r in p.collect()) == [("c", 0, "aa", 1), ("c", 0, "bb", 3), ("c", 0, "cc", 1), ("d", 0, "a1", 2), ("d", 0, "zz", 1)]
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()


def test_extraction_is_one_pass(spark, tmp_path):
    """One scan of the files, no shuffle; the paragraphs of a file are not grouped again."""
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.docx").write_bytes(pack_docx(1, "one\ntwo"))
    (tmp_path / "c" / "b.docx").write_bytes(b"broken")
    (tmp_path / "c" / "t.txt").write_bytes("é\r\nx".encode("latin-1"))
    d = S.extract(spark, str(tmp_path))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    got = {r.path.rsplit("/", 1)[1]: (r.extractor, r.text, r.error) for r in d.collect()}
    assert got == {"a.docx": ("docx", "one\ntwo\none | cell", None), "b.docx": ("error", "", "BadZipFile"), "t.txt": ("text", "é\nx", None)}


def test_job_state_is_read_and_written_once():
    """A job's news of a batch cost one read, one write and one timer of its state, however many columns and events there are."""
    import pandas as pd

    from dossier_spark.streaming.jobs import JobState

    calls, held = [], {}

    class Value:
        get = lambda self: calls.append("get") or held.get("v")
        exists = lambda self: calls.append("exists") or "v" in held
        update = lambda self, v: calls.append("update") or held.update(v=v)

    handle = SimpleNamespace(getValueState=lambda *a: Value(), registerTimer=lambda t: calls.append("timer"), deleteTimer=lambda t: calls.append("delete"))
    p = JobState("24 hours", False)
    p.init(handle)
    rows = pd.DataFrame({"ts": pd.to_datetime([2, 1, 2], unit="s"), "seq": [3, 1, 2], "status": [None, "a", "b"], "message": ["", "m", None], "progress": [None, 5.0, None], "version": [None, None, 1.0]})
    out = pd.concat(p.handleInputRows(("j",), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert out.iloc[0].tolist()[:5] == ["j", "b", "m", 5, 1] and out["updated_at"].iloc[0] == pd.Timestamp(2, unit="s")
    assert calls == ["get", "timer", "update"]
    late = list(p.handleInputRows(("j",), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert late == [] and calls[3:] == ["get"]
