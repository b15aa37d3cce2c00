"""Table schemas: fields with stable ids, defaults as SQL text, and the types that are supported."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, MapType, NullType, StructField, StructType, _parse_datatype_json_string

from ..errors import InvalidInput, NotSupported
from ..functions.rowid import ROW_ID

_BANNED = ("MapType", "StructType", "NullType", "VariantType", "DayTimeIntervalType", "YearMonthIntervalType", "CalendarIntervalType", "CharType", "VarcharType", "UserDefinedType")


@dataclass
class Field:
    """A column. Files store it under ``physical``, so a new name is a change of metadata only."""

    id: str
    name: str
    type: str  # Spark's JSON
    nullable: bool = True
    default: str | None = None
    metadata: dict = field(default_factory=dict)

    @property
    def kind(self) -> DataType:
        return _parse_datatype_json_string(self.type)

    @property
    def physical(self) -> str:
        return f"f{self.id}"


def check_type(kind: DataType) -> None:
    if type(kind).__name__ in _BANNED or isinstance(kind, (MapType, StructType, NullType)):
        raise NotSupported(f"columns of {kind.simpleString()}")
    if isinstance(kind, DecimalType) and kind.precision > 38:
        raise NotSupported("decimals of more than 38 digits")
    if isinstance(kind, ArrayType):
        check_type(kind.elementType)


def make_field(spark: SparkSession, column: StructField, default: str | None, siblings: StructType | None = None) -> Field:
    check_type(column.dataType)
    out = Field(uuid.uuid4().hex[:12], column.name, column.dataType.json(), column.nullable, default, dict(column.metadata or {}))
    if default is not None:
        check_default(spark, out, siblings or StructType([column]))
    return out


def check_default(spark: SparkSession, f: Field, schema: StructType) -> None:
    """A default is an expression of exactly the field's type; it may use other columns, but
    neither functions nor try_cast, and may not be a constant NULL where the field can't be."""
    text = f.default
    tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    if _calls(tree):
        raise InvalidInput(f"default of {f.name}: functions and try_cast aren't allowed")
    empty = spark.createDataFrame([], schema)
    try:
        got = empty.select(F.expr(text).alias("d")).schema["d"]
    except Exception as e:
        raise InvalidInput(f"default of {f.name}: {text}") from e
    if isinstance(got.dataType, NullType):
        if not f.nullable:
            raise InvalidInput(f"default of {f.name} is NULL")
    elif got.dataType != f.kind:
        raise InvalidInput(f"default of {f.name} is {got.dataType.simpleString()}, not {f.kind.simpleString()}")


def _calls(tree) -> bool:
    """Whether a parsed expression calls a function (operators and CAST aren't calls)."""
    kind = tree.getClass().getSimpleName()
    if kind == "UnresolvedFunction" and any(c.isalpha() for c in tree.nameParts().last()) or kind == "Cast" and "TRY" in tree.evalMode().toString():
        return True
    children = tree.children()
    return any(_calls(children.apply(i)) for i in range(children.size()))


def make_fields(spark: SparkSession, schema: StructType, defaults: dict[str, str] | None = None) -> list[Field]:
    names = [c.name for c in schema]
    if not names:
        raise InvalidInput("a table needs a column")
    if len(set(names)) != len(names):
        raise InvalidInput("columns of equal name")
    if ROW_ID in names:
        raise InvalidInput(f"{ROW_ID} is the row id")
    if unknown := set(defaults or {}) - set(names):
        raise InvalidInput(f"defaults of columns that aren't there: {sorted(unknown)}")
    return [make_field(spark, c, (defaults or {}).get(c.name), schema) for c in schema]


def logical_schema(fields: list[Field]) -> StructType:
    return StructType([StructField(f.name, f.kind, f.nullable, f.metadata) for f in fields])


def physical_schema(fields: list[Field]) -> StructType:
    return StructType([StructField(ROW_ID, _parse_datatype_json_string('"binary"'))] + [StructField(f.physical, f.kind) for f in fields])


def to_json(fields: list[Field]) -> list[dict]:
    return json.loads(json.dumps([asdict(f) for f in fields]))


def from_json(items: list[dict]) -> list[Field]:
    return [Field(**i) for i in items]


def aligned(df: DataFrame, fields: list[Field], keep_row_id: bool) -> DataFrame:
    """Rows to insert under physical names: any order of columns, omitted ones from their
    defaults, types exactly as declared, NULLs refused where a field has none."""
    given = {c.name: c for c in df.schema}
    if unknown := set(given) - {f.name for f in fields} - ({ROW_ID} if keep_row_id else set()):
        raise InvalidInput(f"columns that aren't there: {sorted(unknown)}")
    if keep_row_id and ROW_ID not in given:
        raise InvalidInput(f"{ROW_ID} is missing")
    for f in fields:  # in order, so a default may use one before it
        if f.name not in given and f.default is not None:
            df = df.withColumn(f.name, F.expr(f.default).cast(f.kind))
    out: list[Column] = [F.col(ROW_ID)] if keep_row_id else []
    for f in fields:
        if f.name in given:
            got = given[f.name].dataType
            if not _same(got, f.kind):
                raise InvalidInput(f"{f.name} is {got.simpleString()}, not {f.kind.simpleString()}")
            value = F.col(f"`{f.name}`")
        elif f.default is not None:
            value = F.col(f"`{f.name}`")
        elif f.nullable:
            value = F.lit(None).cast(f.kind)
        else:
            raise InvalidInput(f"{f.name} has neither value nor default")
        if not f.nullable and (f.name not in given or given[f.name].nullable):
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{f.name} is NULL")).cast(f.kind)).otherwise(value)
        out.append(value.alias(f.physical))
    return df.select(*out)


def _same(a: DataType, b: DataType) -> bool:
    """Equal but for whether list elements may be NULL."""
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return _same(a.elementType, b.elementType) and (b.containsNull or not a.containsNull)
    return a == b
