"""Schemas of the entities. Lists on disk keep their order in ``ord``; NULL is absent, '' stays ''."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SOURCES = "source_id string, path string, duration double, label string, ord bigint"
UTTERANCES = "utt_id string, source_id string, start double, end double, text string, text_origin string, ord bigint"
UNITS = (
    "unit_id string, source_id string, utt_id string, start double, end double, cv_boundary double, char string, pinyin string, tone int, initial string, final string, "
    "prev_id string, next_id string, f0_midi double, f0_std double, voiced_ratio double, nucleus_start double, nucleus_end double, energy_db double, "
    "align_source string, align_error double, rejected string, ord bigint"
)
FRAMES = "entity_id string, i int, hz double, db double, flux double"
SYLLABLES = "song_id string, idx int, char string, pinyin string, tone int, initial string, final string, start double, vowel_start double, end double"
NOTES = "song_id string, n int, start double, end double, pitch int, syllable int, slur boolean"
REGION = "struct<start:double,end:double>"
SEGMENTS = (
    f"segment_id string, start double, end double, alias string, notes string, regions struct<onset:{REGION},nucleus:{REGION},tail:{REGION}>, "
    "score struct<clarity_score:double,stability_score:double,recommended_role:string,onset_strength:double,voiced_ratio:double,noise_penalty:double>"
)
PROJECT = f"audio_path string, sample_rate int, cut_points array<double>, segments array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in ['segment_id string', 'start double', 'end double', 'alias string', 'notes string'])}>>, settings map<string,string>"


def conform(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """df with exactly the columns of schema: unknown ones go, missing ones are NULL or their default."""
    have, defaults = set(df.columns), defaults or {}
    out = []
    for f in StructType.fromDDL(schema):
        c = F.col(f.name) if f.name in have else F.lit(None)
        c = F.coalesce(c, F.lit(defaults[f.name])) if f.name in defaults else c
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded half to even, as they are kept on disk."""
    return df.withColumns({n: F.bround(n, digits) for n, t in df.dtypes if t == "double"})
