"""Schemas of the tables that the operators read and write."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

PROTEINS = _struct(("split", _S), ("entry", _S), ("row_no", _L), ("sequence", _S), ("label", _S))
HITS = _struct(("query", _S), ("target", _S), ("bits", _D), ("evalue", _D), ("prob", _D), ("alntmscore", _D), ("fident", _D), ("lddt", _D))
HITS_SHORT = _struct(("query", _S), ("target", _S), ("bits", _D), ("evalue", _D), ("prob", _D), ("alntmscore", _D))
PREDICTIONS = _struct(("query", _S), ("pred", _S), ("n_hits", _I), ("top_score", _D), ("true", _S))
VECTORS = T.StructType([*_struct(("split", _S), ("entry", _S), ("label", _S)), T.StructField("features", T.ArrayType(_D))])
FEATURE_COLUMNS = _struct(("column", _S), ("group", _S))
MOTIFS = _struct(("class", _S), ("motif", _S), ("weight", _D))

#: The standard residues, one letter each, and their three-letter names.
AMINO = "ACDEFGHIKLMNPQRSTVWY"
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
#: Kyte-Doolittle hydropathy, and the aromatic residues.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
AROMATIC = "FWY"
