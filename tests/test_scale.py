"""Findings on larger tables: results at ties, and plans that do a step once."""

import duckdb
import pytest

from logtide import catalogue, framed  # noqa: F401  framed registers its queries
from logtide.operators import transactions
from logtide.operators.held import as_it_is, as_table
from logtide.sources import binary
from logtide.sources.frames import FRAMES


def test_products_of_floats_are_rounded_as_in_sql(spark, tmp_path):
    folder = tmp_path / "embeddings.parquet"
    own = [(1, [0.25605, 0.027449999, -0.13945]), (2, [0.1, -0.00005, 0.99995]), (3, [0.5, 0.0, -0.5])]
    spark.createDataFrame(own, "vec_id long, embedding array<float>").write.parquet(str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/*.parquet'")
    got = [tuple(r) for r in catalogue.array_parse_2d(spark, str(tmp_path)).orderBy("vec_id").collect()]
    assert got == con.sql(catalogue.ORACLE_SQL["array_parse_2d"] + " ORDER BY vec_id").fetchall()
    assert got[0] == (1, 2561, 275, -1395)


@pytest.mark.parametrize("name", ["frames_to_changes", "frames_to_transactions", "frames_to_messages", "frames_to_mirror", "frames_without_faults"])
def test_frames_are_made_and_decoded_once(spark, name):
    """What is read several times is held: no part of the plan runs the encoder or the decoder again."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


def test_numbers_of_a_streamed_transaction_over_stretches(spark):
    """Two interleaved streams whose segments cross stretches: ordinals count on, truncates count each relation, an aborted part leaves a gap."""
    size, out = 40_000, [(0, binary.encode_relation(1, "a", "t", [("k", 20, True)])), (1, binary.encode_relation(2, "a", "u", [("k", 20, True)]))]
    for segment in range(6):
        at, xid = 10 + segment * size, 7 + segment % 2
        out.append((at, binary.encode_stream_start(xid, segment < 2)))
        for i in (5, 6, 30_000, 39_000):
            out.append((at + i, binary.encode_row(b"I", 1, [str(at + i)], subxid=xid + (100 if i == 6 else 0))))
        out.append((at + 31_000, binary.encode_truncate([1, 2], subxid=xid)))
        out.append((at + size - 1, binary.STREAM_STOP))
    end = 10 + 6 * size
    out += [(end, binary.encode_stream_abort(7, 107)), (end + 1, binary.encode_stream_commit(8, 900, 901, 0)), (end + 2, binary.encode_stream_commit(7, 950, 951, 0))]
    frames = spark.createDataFrame([(seq, seq, "w", bytearray(p), False) for seq, p in out], FRAMES)
    for hold in (as_it_is, as_table):
        got = transactions.assemble(binary.decode(transactions.in_segments(frames, hold), "pgoutput"), hold=hold)
        rows = [(r["commit_lsn"], r["ordinal"], r["op"], r["relid"]) for r in got.changes.orderBy("commit_lsn", "ordinal").collect()]
        each = lambda first, gap: [(first + i, "insert", 1) for i in (0, 1, 2) if not (gap and i == 1)] + [(first + 3, "truncate", 1), (first + 4, "truncate", 2), (first + 5, "insert", 1)]
        assert rows == [(900, *x) for s in range(3) for x in each(6 * s, False)] + [(950, *x) for s in range(3) for x in each(6 * s, True)]
        assert got.halts.count() == 0 and got.open_from.count() == 0


@pytest.mark.parametrize("name", ["decode_pgoutput", "decode_pglogical", "decoder_parity"])
def test_rows_of_a_relation_do_not_meet_in_one_task(spark, name):
    """The one relation goes to the rows, which are dealt over the tasks; announcing it makes no frame of them."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
