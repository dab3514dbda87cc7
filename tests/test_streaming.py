"""Stream = batch for the query-log classification (T1) and routed search."""

from conftest import SF_SMALL
import __spark_entry__ as E
from lectio.sources import tables as T
from lectio.sources.dictionaries import synthetic_dictionaries
from lectio.streaming.streams import classify_log


def _rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def test_query_log_stream_equals_batch(spark):
    stream = E.queries()["query_log_stream"](spark, SF_SMALL)
    batch = classify_log(T.table(spark, SF_SMALL, "conversations"), synthetic_dictionaries(spark))
    assert _rows(stream) == _rows(batch)


def test_search_stream_equals_batch(spark):
    stream = E.queries()["search_stream"](spark, SF_SMALL)
    batch = E.queries()["routed_search"](spark, SF_SMALL)
    assert _rows(stream) == _rows(batch)


def test_replayed_epochs_change_nothing(spark, monkeypatch):
    """Every micro-batch (one file each) is committed twice, as after a failure between the sink
    and the stream's own checkpoint."""
    from lectio.sources.manifest import EpochSink
    write, epochs = EpochSink.write, []

    def twice(self, rows, epoch):
        write(self, rows, epoch)
        write(self, rows, epoch)
        epochs.append(epoch)
    monkeypatch.setattr(EpochSink, "write", twice)
    stream = E.queries()["search_stream"](spark, SF_SMALL)
    assert len(epochs) >= 2 and _rows(stream) == _rows(E.queries()["routed_search"](spark, SF_SMALL))
