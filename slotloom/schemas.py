"""Schemas of module documents, datapoint tables and service tables."""

from __future__ import annotations

from pyspark.sql import types as T

PREDICTION = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("score", T.DoubleType())]))
_S = T.StringType()
_OCCUR = T.MapType(_S, T.ArrayType(T.ArrayType(_S)))
_LINES = T.MapType(_S, T.ArrayType(T.ArrayType(T.IntegerType())))
#: Predictions are stored as pairs of a type and a number; read as text, then cast.
_RAW = T.MapType(_S, T.ArrayType(T.ArrayType(_S)))


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FUNCTION = _struct(
    name=_S, q_name=_S, docstring=_struct(func=_S, long_descr=_S, ret=_S), fn_lc=T.ArrayType(T.ArrayType(T.IntegerType())), params=T.MapType(_S, _S), params_occur=_OCCUR, params_descr=T.MapType(_S, _S),
    ret_exprs=T.ArrayType(_S), ret_type=_S, variables=T.MapType(_S, _S), fn_var_occur=_OCCUR, fn_var_ln=_LINES, params_p=_RAW, variables_p=_RAW, ret_type_p=T.ArrayType(T.ArrayType(_S)),
)
CLASS = _struct(name=_S, q_name=_S, variables=T.MapType(_S, _S), cls_var_occur=_OCCUR, cls_var_ln=_LINES, funcs=T.ArrayType(FUNCTION), variables_p=_RAW)
MODULE = _struct(
    classes=T.ArrayType(CLASS), funcs=T.ArrayType(FUNCTION), imports=T.ArrayType(_S), variables=T.MapType(_S, _S), mod_var_occur=_OCCUR, mod_var_ln=_LINES,
    no_types_annot=_struct(D=T.IntegerType(), I=T.IntegerType(), U=T.IntegerType()), type_annot_cove=T.DoubleType(), set=_S, tc=T.ArrayType(_S), typed_seq=_S, untyped_seq=_S, variables_p=_RAW,
)
FUNCTIONS = _struct(
    author=_S, repo=_S, file=_S, set=_S, has_type=T.BooleanType(), name=_S, func_descr=_S, arg_names=T.ArrayType(_S), arg_types=T.ArrayType(_S), arg_descrs=T.ArrayType(_S),
    args_occur=T.ArrayType(T.ArrayType(_S)), return_type=_S, return_expr=T.ArrayType(_S), aval_types=_S,
)
VARIABLES = _struct(author=_S, repo=_S, file=_S, set=_S, var_name=_S, var_type=_S, var_occur=T.ArrayType(_S), aval_types=_S)
REQUESTS = _struct(
    id=T.LongType(), hashed_IP=_S, act_id=_S, sess_id=_S, file_hash=_S, start_t=T.TimestampNTZType(), finished_t=T.TimestampNTZType(), error=_S, extracted_features=_S, extension_ver=_S,
)
ACCEPTED = _struct(
    id=T.LongType(), sess_id=_S, accepted_type=_S, rank=T.IntegerType(), type_slot=_S, id_name=_S, id_ln=T.IntegerType(), canceled_preds=T.BooleanType(), filtered_preds=T.BooleanType(), timestamp=T.TimestampType(),
)
