"""Declared schemas; production reads never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INTERACTIONS = T.StructType([
    T.StructField("Identifier", _S), T.StructField("id", _I), T.StructField("random_id", _S),
    T.StructField("ResponseType", _S), T.StructField("TrialNumber", _I), T.StructField("Response", _S),
    T.StructField("Group", _I), T.StructField("Points", _I), T.StructField("prev_response", _S),
    T.StructField("partner_id", _I), T.StructField("partner_prev_response", _S),
    T.StructField("partner_response", _S), T.StructField("BC", _S), T.StructField("DecisionType", _S),
    T.StructField("Content", _S), T.StructField("Size", _I), T.StructField("Structure", _S),
    T.StructField("Run", _I), T.StructField("ssid", _S),
])

RUN_LOG = _struct(id=_I, ResponseType=_S, TrialNumber=_I, Response=_S, Group=_I, Points=_I, DecisionType=_S)

HASHTAG_SLOTS = 10
PREPOST = T.StructType(
    [T.StructField("RecordedDate", _S), T.StructField("tweet1", _S)]
    + [T.StructField(f"hashtag1_{i}", _S) for i in range(1, HASHTAG_SLOTS + 1)]
    + [T.StructField("tweet2", _S)]
    + [T.StructField(f"hashtag2_{i}", _S) for i in range(1, HASHTAG_SLOTS + 1)]
    + [T.StructField("random ID", _S)]
)

TWEETS = _struct(Structure=_S, Content=_S, Size=_I, Phase=_S, random_id=_S, Response=_S)
CLAIMS = _struct(text=_S, cause=_S, effect=_S, cause_cluster=_I, effect_cluster=_I)
PAIRS = _struct(Node1=_I, Node2=_I, Trial=_I)
EDGES = _struct(u=T.LongType(), v=T.LongType())
SWEEP = _struct(alpha=_D, entropy_dist=_D, bn_dist=_D, ec_dist=_D, rs_dist=_D, rp_dist=_D)

# Question payload of a survey definition; other element kinds carry other shapes,
# so the payload is read as text and parsed for question rows only.
SURVEY_QUESTION = T.StructType([
    T.StructField("DataExportTag", _S),
    T.StructField("QuestionText", _S),
    T.StructField("QuestionType", _S),
    T.StructField("Selector", _S),
    T.StructField("Validation", T.StructType([
        T.StructField("Settings", T.StructType([
            T.StructField("Type", _S), T.StructField("MinChars", _S), T.StructField("TotalChars", _S),
        ])),
    ])),
])
SURVEY = T.StructType([
    T.StructField("SurveyEntry", T.StructType([
        T.StructField("SurveyID", _S), T.StructField("SurveyName", _S),
    ])),
    T.StructField("SurveyElements", T.ArrayType(T.StructType([
        T.StructField("SurveyID", _S), T.StructField("Element", _S),
        T.StructField("PrimaryAttribute", _S), T.StructField("SecondaryAttribute", _S),
        T.StructField("TertiaryAttribute", _S), T.StructField("Payload", _S),
    ]))),
])
