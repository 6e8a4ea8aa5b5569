"""What the writer of a shard holds doesn't grow with the texts of the shard."""

import gc

import pyarrow as pa

from logwarden.llm import bitpack
from logwarden.llm.tables import BYTE_BPE, vocabulary_path


class _Context:
    def partitionId(self):
        return 0


def test_batches_are_given_back(monkeypatch, tmp_path):
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: _Context()))
    held = []

    def batches():
        for i in range(8):
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None if i == 3 else i], pa.int64()), "text": ["word " * 200_000]})
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            # As from Spark: all columns of a batch are views of one buffer that is read.
            source = pa.ipc.open_stream(pa.PythonFile(pa.BufferReader(sink.getvalue()), "r"))
            del sink, batch
            yield source.read_next_batch()
            del source
            gc.collect()
            held.append(pa.total_allocated_bytes())

    rows = list(bitpack._write(str(tmp_path), vocabulary_path(BYTE_BPE), 0, 16, 1 << 16, batches()))
    assert rows[0].column("n_docs").to_pylist() == [8] and rows[0].column("first_doc").to_pylist() == [0]
    assert held[-1] - held[1] < 2_000_000
    with pa.OSFile(f"{tmp_path}/{rows[0].column('file')[0].as_py()}") as file:
        shard = bitpack.Shard(file)
        assert shard.null.tolist() == [i == 3 for i in range(8)] and len(set(shard.sizes.tolist())) == 1


def test_encoders_end_when_shards_are_read(tmp_path):
    """An idle worker held what it knew beside the next step's memory (pipeline, toxicity after token output)."""
    bitpack.encoder(vocabulary_path(BYTE_BPE), 0).encode(["some words of a text"])
    assert bitpack._ENCODERS
    list(bitpack._read(str(tmp_path), iter([pa.RecordBatch.from_pydict({"file": pa.array([], pa.string()), "start": pa.array([], pa.int64())})])))
    assert not bitpack._ENCODERS
