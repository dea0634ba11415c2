"""Declared schemas of the tables passed between operators."""

from pyspark.sql import types as T

SIGNAL = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("time", T.LongType()),
    T.StructField("signal_raw", T.DoubleType()),
])

LABELS = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType())])

SPECTRUM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("freq_num", T.IntegerType()),
    T.StructField("signal_binned_fft", T.DoubleType()),
])

TRACE_HEADER = T.StructType([T.StructField("numTraces", T.IntegerType()), T.StructField("traceSize", T.IntegerType())])

ALARM = T.StructType([
    T.StructField("zone", T.IntegerType()),
    T.StructField("date", T.StringType()),
    T.StructField("hour", T.StringType()),
    T.StructField("alarm_no", T.IntegerType()),
    T.StructField("date_time", T.TimestampType()),
    T.StructField("signal", T.ArrayType(T.DoubleType())),
    T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("label", T.StringType()),
])

ALARM_MESSAGE = T.StructType([
    T.StructField("nchn", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("alarm", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
])


def require(df, schema: T.StructType):
    """Fail early when ``df`` lacks a column of ``schema``; extra columns are allowed."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df
