import pyarrow as pa
import pyarrow.compute as pc

from tarn.llm import arrow


def test_slices_of_texts():
    whole = pa.array(["Abc", None, "DEF", "", "ghij", "É"])
    for lo in range(7):
        for n in range(7 - lo):
            part = whole.slice(lo, n)
            assert pc.ascii_lower(arrow.large_text(part)).to_pylist() == [(t or "").replace("DEF", "def").replace("Abc", "abc") for t in part.to_pylist()]


def test_slices_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 7, "c" * 100, ""])], ["text"])
    parts = [p.column(0).to_pylist() for p in arrow.slices(batch, 0, 12)]
    assert parts == [["aaaaa", None, "bbbbbbb"], ["c" * 100], [""]] or parts == [["aaaaa", None, "bbbbbbb"], ["c" * 100, ""]]
