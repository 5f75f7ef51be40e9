"""Names of coded values, as enumerations and as small dimension tables."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession


# Marker codes of the codestream syntax.
class Marker(IntEnum):
    SOC = 0xFF4F
    CAP = 0xFF50
    SIZ = 0xFF51
    COD = 0xFF52
    COC = 0xFF53
    TLM = 0xFF55
    PRF = 0xFF56
    PLM = 0xFF57
    PLT = 0xFF58
    CPF = 0xFF59
    QCD = 0xFF5C
    QCC = 0xFF5D
    RGN = 0xFF5E
    POC = 0xFF5F
    PPM = 0xFF60
    PPT = 0xFF61
    CRG = 0xFF63
    COM = 0xFF64
    DFS = 0xFF72
    ATK = 0xFF79
    SOT = 0xFF90
    SOP = 0xFF91
    EPH = 0xFF92
    SOD = 0xFF93
    EOC = 0xFFD9


class Progression(IntEnum):
    LRCP = 0
    RLCP = 1
    RPCL = 2
    PCRL = 3
    CPRL = 4
    PRCL = 5


class Split(IntEnum):
    NONE = 0
    BOTH = 1
    HORZ = 2
    VERT = 3


class AbortReason(IntEnum):
    GAP = 1
    PARSE = 2
    MISSED_EOC = 3
    SLAB_CAP = 4
    DAMAGED_EOC = 5


class RelatchReason(IntEnum):
    GEOMETRY = 1
    PARSE_FAIL = 2


#: Progressions whose precinct order is defined here.
SUPPORTED_PROGRESSIONS = (Progression.PCRL, Progression.PRCL)
#: Segments that a geometry signature covers.
GEOMETRY_MARKERS = (Marker.SIZ, Marker.COD, Marker.COC, Marker.QCD, Marker.QCC, Marker.DFS, Marker.ATK)


def dimension(spark: SparkSession, kind: type[IntEnum]) -> DataFrame:
    """(code, name) of an enumeration."""
    return spark.createDataFrame([(int(x), x.name) for x in kind], "code int, name string")
