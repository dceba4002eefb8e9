"""Which acoustic model a language preset calls for: a small ordered rule table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Presets by model class, in order of precedence.
ENGLISH = ("en-us", "en", "en-gb", "en-029", "en-gb-x-gbclan", "en-gb-x-rp", "en-gb-scotland", "en-gb-x-gbcwmd")
EUROPEAN = (
    "de", "fr", "fr-be", "fr-ch", "es", "es-419", "it", "pt", "pt-br", "pl", "nl", "da", "sv", "nb", "is", "cs", "sk", "sl", "hr", "bs", "sr", "mk", "bg", "ro", "hu",
    "et", "lv", "lt", "ca", "an", "pap", "ht", "af", "lb", "ga", "gd", "cy",
)
DEFAULT_LANG = "en-us"


def model_class(preset: Column) -> Column:
    """english, european8 or universal; null for an empty preset."""
    return F.when(preset.isin(*ENGLISH), "english").when(preset.isin(*EUROPEAN), "european8").when(preset != "", "universal")


def resolved(preset: Column, lang: Column, model: Column | None = None) -> tuple[Column, Column]:
    """(model, language): an explicit model wins; the default language gives way to the preset's."""
    preset = F.coalesce(preset, F.lit(DEFAULT_LANG))
    lang = F.coalesce(lang, F.lit(DEFAULT_LANG))
    chosen = model_class(preset)
    return (F.coalesce(model, chosen) if model is not None else chosen), F.when(lang == DEFAULT_LANG, preset).otherwise(lang)
