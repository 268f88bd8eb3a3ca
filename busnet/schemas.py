"""Declared schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])
LINE = T.ArrayType(POINT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TAGS = T.MapType(T.StringType(), T.StringType())

# --- OSM elements -----------------------------------------------------------
# version and visible may be missing in stored tables
_STATE = {"version": T.LongType(), "visible": T.BooleanType()}
OSM_NODE = _struct(id=T.LongType(), lat=T.DoubleType(), lon=T.DoubleType(), tags=_TAGS, **_STATE)
OSM_WAY = _struct(id=T.LongType(), nds=T.ArrayType(T.LongType()), tags=_TAGS, **_STATE)
OSM_RELATION = _struct(
    id=T.LongType(),
    members=T.ArrayType(_struct(type=T.StringType(), ref=T.LongType(), role=T.StringType())),
    tags=_TAGS, **_STATE,
)

_XML_TAG = T.ArrayType(_struct(_k=T.StringType(), _v=T.StringType()))
_XML_STATE = {"_version": T.LongType(), "_visible": T.BooleanType()}
XML_NODE = _struct(_id=T.LongType(), _lat=T.DoubleType(), _lon=T.DoubleType(), tag=_XML_TAG, **_XML_STATE)
XML_WAY = _struct(_id=T.LongType(), nd=T.ArrayType(_struct(_ref=T.LongType())), tag=_XML_TAG, **_XML_STATE)
XML_RELATION = _struct(
    _id=T.LongType(),
    member=T.ArrayType(_struct(_type=T.StringType(), _ref=T.LongType(), _role=T.StringType())),
    tag=_XML_TAG, **_XML_STATE,
)

# --- feature tables ---------------------------------------------------------
STOP_FLAGS = [
    "has_shelter", "has_bench", "has_tactile_paving", "has_departures_board", "is_wheelchair_ok",
]

BUS_STOP = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("osm_id", T.LongType()),
     T.StructField("name", T.StringType())]
    + [T.StructField(f, T.BooleanType()) for f in STOP_FLAGS]
    + [T.StructField("local_ref", T.StringType()), T.StructField("highway", T.StringType()),
       T.StructField("public_transport", T.StringType()), T.StructField("geom", LINE)]
)
BUS_STATION = _struct(
    id=T.LongType(), osm_id=T.LongType(), name=T.StringType(), geom_type=T.StringType(), geom=LINE,
    rings=T.ArrayType(_struct(hole=T.BooleanType(), geom=LINE)),
)
RELATIONS_ROUTE = _struct(
    osm_id=T.LongType(), name=T.StringType(), ref=T.StringType(), network=T.StringType(),
    origin=T.StringType(), destination=T.StringType(), colour=T.StringType(),
    operator=T.StringType(), public_transport_version=T.StringType(),
    transport_mode=T.StringType(),
)
RELATION_MEMBERS_ROUTE = _struct(
    rel_osm_id=T.LongType(), member_osm_id=T.LongType(), member_index=T.IntegerType(),
    member_role=T.StringType(), member_type=T.IntegerType(), geom=LINE,
)
