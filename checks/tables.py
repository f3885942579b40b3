"""Schemas of the driver tables, so that no read has to open files to infer them."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, DOUBLE, TIME = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType(),
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCHEMAS = {
    "region": _schema(r_regionkey=INT, r_name=STR),
    "nation": _schema(n_nationkey=INT, n_name=STR, n_regionkey=INT),
    "customer": _schema(
        c_custkey=LONG, c_name=STR, c_nationkey=INT, c_acctbal=DOUBLE, c_mktsegment=STR
    ),
    "supplier": _schema(s_suppkey=LONG, s_name=STR, s_nationkey=INT, s_acctbal=DOUBLE),
    "part": _schema(
        p_partkey=LONG, p_name=STR, p_brand=STR, p_type=STR, p_size=INT, p_retailprice=DOUBLE
    ),
    "orders": _schema(
        o_orderkey=LONG, o_custkey=LONG, o_orderstatus=STR, o_totalprice=DOUBLE, o_orderdate=TIME,
        o_orderpriority=STR,
    ),
    "lineitem": _schema(
        l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=DOUBLE,
        l_extendedprice=DOUBLE, l_discount=DOUBLE, l_tax=DOUBLE, l_returnflag=STR, l_linestatus=STR,
        l_shipdate=TIME,
    ),
    "events": _schema(
        event_id=LONG, ts=TIME, user_id=LONG, event_type=STR, value=DOUBLE, props=STR
    ),
    "conversations": _schema(conv_id=LONG, turn=LONG, role=STR, text=STR),
}
