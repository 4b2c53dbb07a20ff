"""Column specifications: which columns a table has, their types and their rules.

Every operator takes a :class:`FeatureSpec`, so it runs on any table; the campaign
schema is the preset ``CAMPAIGN``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldRule:
    """Declared type and limits of one input column.

    ``allowed`` is enforced always; ``documented`` only when a caller asks for
    strict domains.
    """

    name: str
    kind: str  # "int", "float" or "str"
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple[str, ...] = ()
    documented: tuple[str, ...] = ()

    @property
    def spark_type(self) -> T.DataType:
        return {"int": T.IntegerType(), "float": T.DoubleType(), "str": T.StringType()}[self.kind]


@dataclass(frozen=True)
class FeatureSpec:
    """Roles of the columns of one table."""

    key: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str
    positive: str = "yes"
    negative: str = "no"
    rules: tuple[FieldRule, ...] = ()
    unknown_tokens: tuple[str, ...] = ("unknown",)

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def inputs(self) -> tuple[str, ...]:
        """Input columns in declared order (falls back to numeric, categorical)."""
        return tuple(r.name for r in self.rules) or self.features

    def with_key(self, key: str) -> "FeatureSpec":
        return replace(self, key=key)

    def input_schema(self, key_type: T.DataType | None = None) -> T.StructType:
        fields = [] if key_type is None else [T.StructField(self.key, key_type)]
        return T.StructType(fields + [T.StructField(r.name, r.spark_type) for r in self.rules])

    def table_schema(self, key_type: T.DataType | None = None) -> T.StructType:
        return T.StructType(
            self.input_schema(key_type).fields + [T.StructField(self.target, T.StringType())]
        )

    def text_schema(self, key_type: T.DataType | None = None) -> T.StructType:
        """All inputs as text: the edge schema, coerced and checked by validation."""
        fields = [] if key_type is None else [T.StructField(self.key, key_type)]
        return T.StructType(fields + [T.StructField(r.name, T.StringType()) for r in self.rules])


# The campaign columns, their limits and their documented domains.
YES_NO = ("yes", "no")
MARITAL = ("single", "married", "divorced")
JOBS = (
    "admin.", "blue-collar", "entrepreneur", "housemaid", "management", "retired",
    "self-employed", "services", "student", "technician", "unemployed", "unknown",
)
EDUCATION = ("primary", "secondary", "tertiary", "unknown")
CONTACT = ("cellular", "telephone", "unknown")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
POUTCOME = ("success", "failure", "other", "unknown")

CAMPAIGN = FeatureSpec(
    key="contact_id",
    numeric=("age", "balance", "day", "duration", "campaign", "pdays", "previous"),
    categorical=(
        "job", "marital", "education", "default", "housing", "loan", "contact", "month", "poutcome",
    ),
    target="deposit",
    rules=(
        FieldRule("age", "int", minimum=0, maximum=120),
        FieldRule("job", "str", documented=JOBS),
        FieldRule("marital", "str", allowed=MARITAL),
        FieldRule("education", "str", documented=EDUCATION),
        FieldRule("default", "str", allowed=YES_NO),
        FieldRule("balance", "float"),
        FieldRule("housing", "str", allowed=YES_NO),
        FieldRule("loan", "str", allowed=YES_NO),
        FieldRule("contact", "str", documented=CONTACT),
        FieldRule("day", "int", minimum=1, maximum=31),
        FieldRule("month", "str", documented=MONTHS),
        FieldRule("duration", "int", minimum=0),
        FieldRule("campaign", "int", minimum=1),
        FieldRule("pdays", "int"),
        FieldRule("previous", "int", minimum=0),
        FieldRule("poutcome", "str", documented=POUTCOME),
    ),
)

# Defaults of the training and evaluation jobs.
SPLIT_SEED = 42
TEST_SHARE = 0.2
CV_FOLDS = 10
DEFAULT_MODEL_NAME = "decision-tree"
HISTORY_LIMIT = 100
METRIC_FIELDS = ("accuracy", "precision", "recall", "f1_score", "auc_roc")

# History tables.
_CLASS_ENTRY = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("support", T.LongType()),
])

METRICS_STRUCT = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("auc_roc", T.DoubleType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("classification_report", T.MapType(T.StringType(), _CLASS_ENTRY)),
    T.StructField("report_accuracy", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("roc_curve", T.StructType([
        T.StructField("fpr", T.ArrayType(T.DoubleType())),
        T.StructField("tpr", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("precision_recall_curve", T.StructType([
        T.StructField("precision", T.ArrayType(T.DoubleType())),
        T.StructField("recall", T.ArrayType(T.DoubleType())),
    ])),
])

METRICS_HISTORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("metrics", METRICS_STRUCT, False),
    T.StructField("created_at", T.TimestampNTZType(), False),
])


def prediction_history_schema(spec: FeatureSpec = CAMPAIGN, key_type: T.DataType = T.LongType()) -> T.StructType:
    return T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField(spec.key, key_type),
        T.StructField("input_data", spec.input_schema(), False),
        T.StructField("prediction", T.IntegerType(), False),
        T.StructField("probability", T.DoubleType(), False),
        T.StructField("probability_text", T.StringType(), False),
        T.StructField("class_name", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ])


# The schema of the node table that describes a fitted tree (rule: value <= threshold
# goes left).  The root has depth 0; ``left`` and ``right`` are the children's ``node``, null in leaves.
NODE_TABLE = T.StructType([
    T.StructField("node", T.LongType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("feature", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("n", T.LongType(), False),
    T.StructField("n_weighted", T.DoubleType(), False),
    T.StructField("p1", T.DoubleType(), False),
    T.StructField("parent_n", T.LongType()),
    T.StructField("left", T.LongType()),
    T.StructField("right", T.LongType()),
])
