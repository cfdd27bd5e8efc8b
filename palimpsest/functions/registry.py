"""Reference tables as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Script tags in the order of their precedence (name, class, hex prefix of the payload).
TAGS = [
    ("segwit", "segwit", "aa21a9ed"),
    ("rsk", "mm_op_return", b"RSKBLOCK:".hex()),
    ("vcash", "mm_op_return", "b9e11b6d"),
    ("hathor_op_return", "mm_op_return", b"Hath".hex()),
    ("exsat", "non_mm_commitment", b"EXSAT".hex()),
    ("core", "non_mm_commitment", b"CORE".hex()),
    ("sys", "non_mm_commitment", b"sys".hex()),
    ("ocean_ocb1", "non_mm_commitment", b"OCB1".hex()),
    ("segwit_test", "non_mm_commitment", "aa21a9ef"),
    ("vcash_braiins_nested", "mm_op_return", "6a24b9e11b6d"),
    ("pool_op_return:1hash.com", "pool_op_return", b"Mined by 1hash.com".hex()),
    ("ballet_sponsorship", "non_mm_commitment", b"Ballet".hex()),
]

# Ids of merge-mined chains; chains may share an id, and a chain may have had several.
CHAIN_IDS = [
    ("namecoin", 1), ("geistgeld", 0), ("i0coin", 2), ("ixcoin", 3), ("coiledcoin", 16), ("devcoin", 4), ("devcoin-legacy", 4096), ("groupcoin", 5), ("huntercoin", 6), ("fusioncoin", 0),
    ("unobtanium", 117), ("myriadcoin", 90), ("sixeleven", 1), ("argentum", 1187), ("syscoin-1", 4096), ("terracoin", 50), ("emercoin", 666), ("blast-launch", 6464), ("blast-rotated", 164), ("jincoin", 186),
    ("doichain", 2), ("bitmark", 91), ("xaya", 1829), ("elastos", 1224), ("bitcoin-stash", 68), ("syscoin-2", 16), ("bitcoin-vault", 1638), ("electric-cash", 8503), ("lyncoin", 2829), ("fractal", 8228),
]

# Heights from which a rule holds, and the interval of difficulty changes.
HEIGHT_PUSH_V2, HEIGHT_PUSH, VERSION_3, VERSION_4 = 224_413, 227_931, 363_725, 388_381
INTERVAL = 2016


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TAGS)], "ordinal int, tag string, class string, prefix string")
