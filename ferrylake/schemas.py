"""Schemas and fixed values of the transition model."""

from pyspark.sql import types as T

LEDGER = T.StructType(
    [
        T.StructField("src_id", T.StringType(), False),
        T.StructField("tgt_key", T.StringType()),
        T.StructField("type", T.StringType(), False),
        T.StructField("create_time", T.TimestampNTZType()),
        T.StructField("skip_reason", T.StringType()),
        T.StructField("partition_id", T.IntegerType()),
    ]
)

FINDING = T.StructType([T.StructField(n, T.StringType()) for n in ("filename", "element_name", "element_id", "element_type", "severity", "message_id", "message", "link")])

# Fixed values.
HISTORY_PARTITION = 4095
COUNTER_BITS = 51
DEFAULT_TENANT = "<default>"
DEFAULT_PREFIX = "c7-legacy-"
LEGACY_ID = "legacyId"
MULTI_INSTANCE_SUFFIX = "#multiInstanceBody"
SEVERITIES = ("WARNING", "TASK", "REVIEW", "INFO")
#: Target types in the order of their dependencies.
HISTORY_TYPES = (
    "form definition, process definition, process instance, flow node, user task, variable, job, external task, incident, "
    "decision requirements, decision definition, decision instance, audit log"
).split(", ")
IDENTITY_TYPES = ("user", "group", "tenant", "authorization")
RUNTIME_TYPES = ("runtime instance",)
ENTITY_TYPES = (*HISTORY_TYPES, *RUNTIME_TYPES, *IDENTITY_TYPES)
