"""Size-checked broadcast decisions."""

from tally.operators import joins as J
from tally.sources.tables import read_table


def test_byte_bound_and_row_gate(spark, sf_dir, monkeypatch):
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    J.prepare_broadcasts([("t|sup-small", sup, None)], max_bytes=10)       # bytes over the bound
    J.prepare_broadcasts([("t|sup-ok", sup, None)], max_bytes=10 ** 9)
    app = J.app_key(spark)
    assert J._DECISIONS[(app, "t|sup-small")] is False
    assert J._DECISIONS[(app, "t|sup-ok")] is True
    monkeypatch.setattr(J, "MAX_BROADCAST_ROWS", 1)                         # row gate fails first
    called = []
    monkeypatch.setattr(J, "_measure_row", lambda *a: called.append(a))
    J.prepare_broadcasts([("t|sup-rows", sup, None)], max_bytes=10 ** 9)
    assert J._DECISIONS[(app, "t|sup-rows")] is False and called == []


def test_single_and_batched_agree(spark, sf_dir):
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    single = J.measured_bytes(part)
    J.prepare_broadcasts([("t|part-a", part, None)], max_bytes=single)
    J.prepare_broadcasts([("t|part-b", part, None)], max_bytes=single - 1)
    app = J.app_key(spark)
    assert J._DECISIONS[(app, "t|part-a")] is True and J._DECISIONS[(app, "t|part-b")] is False
    assert J.sized_broadcast(part, "t|part-b") is part          # no hint when over the bound
