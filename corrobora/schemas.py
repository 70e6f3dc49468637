"""Explicit table schemas. Nothing is inferred, neither for files nor for streams."""
from pyspark.sql import types as T

_s, _l, _i, _d = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


CITATION = _struct(url=_s, title=_s, source_type=_s, retrieved_at=_s, quote=_s)
CHILD = _struct(claim=_s, source_ids=T.ArrayType(_s), urls=T.ArrayType(_s))

FINDINGS = _struct(
    finding_id=_s, branch_id=_s, claim=_s, source_types=T.ArrayType(_s), urls=T.ArrayType(_s),
    corroboration_count=_i, confidence_tier=_s, node_kind=_s, created_at=_s)
RAW_SOURCES = _struct(url=_s, branch_id=_s, title=_s, source_type=_s, raw_text=_s, char_len=_l,
                      created_at=T.TimestampType())
QUESTION_LEDGER = _struct(text=_s, branch_id=_s, cycle_n=_i, scores=T.MapType(_s, _d), outcome=_s)
FAILURE_LOG = _struct(logged_at=_s, question=_s, path=_s, where_failed=_s,
                      reasoning_trail=T.ArrayType(_s), correction=_s, status=_s, branch_id=_s)
VALIDATION_LOG = _struct(url=_s, topic=_s, passed=T.BooleanType(), reasons=T.ArrayType(_s), n_words=_l)
LEDGER_PAYLOAD = _struct(claim=_s, verdict=_s, lean=_s, magnitude=_s, why=_s)
SEGMENTS = T.ArrayType(_struct(text=_s))

EVENTS = _struct(event_id=_l, ts=T.TimestampNTZType(), user_id=_l, event_type=_s, value=_d, props=_s)
LINEITEM = _struct(
    l_orderkey=_l, l_partkey=_l, l_suppkey=_l, l_linenumber=_i, l_quantity=_d, l_extendedprice=_d,
    l_discount=_d, l_tax=_d, l_returnflag=_s, l_linestatus=_s, l_shipdate=T.TimestampNTZType())
ORDERS = _struct(o_orderkey=_l, o_custkey=_l, o_orderstatus=_s, o_totalprice=_d,
                 o_orderdate=T.TimestampNTZType(), o_orderpriority=_s)
DOCUMENTS = _struct(doc_id=_l, text=_s, lang=_s, source=_s, n_chars=_l)
