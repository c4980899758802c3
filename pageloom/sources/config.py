"""Model configuration and vocabularies, read on the driver or as columns."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of a model's config.json.
DEFAULTS = {"pad_token_id": 1, "eos_token_id": 2, "decoder_layers": 6, "decoder_attention_heads": 8, "d_model": 512}


def model_path(config: str, key: str) -> str:
    """The path that a JSON file gives for a key; FileNotFoundError if there is none."""
    try:
        found = json.loads(Path(config).read_text(encoding="utf-8")).get(key)
    except FileNotFoundError as e:
        raise FileNotFoundError(f"no configuration at {config}") from e
    if not found or not str(found).strip():
        raise FileNotFoundError(f"{config} gives no path for {key}")
    return found


def required(folder: str, name: str) -> Path:
    path = Path(folder) / name
    if not path.is_file():
        raise FileNotFoundError(f"missing file {path}")
    return path


def model_numbers(config: Column) -> Column:
    """struct of pad, eos, start, layers, heads, head_dim from config.json text."""
    get = lambda name: F.get_json_object(config, f"$.{name}").cast("int")
    value = {name: F.coalesce(get(name), F.lit(default)) for name, default in DEFAULTS.items()}
    start = F.coalesce(get("decoder_start_token_id"), value["pad_token_id"])
    heads = value["decoder_attention_heads"]
    return F.struct(value["pad_token_id"].alias("pad"), value["eos_token_id"].alias("eos"), start.alias("start"), value["decoder_layers"].alias("layers"), heads.alias("heads"), F.floor(value["d_model"] / heads).cast("int").alias("head_dim"))


def vocabulary(text: Column) -> Column:
    """map<string,int> of vocabulary JSON; an error for an empty one."""
    found = F.from_json(text, "map<string,int>")
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.raise_error(F.lit("empty vocabulary")))


def unknown_id(vocab: Column) -> Column:
    return F.coalesce(F.try_element_at(vocab, F.lit("<unk>")), F.lit(1))


def language_codes(tokenizers: DataFrame, text_col: str, codes: list[str]) -> DataFrame:
    """(content, id) of the language codes among added_tokens; an error for a missing one."""
    kind = "struct<added_tokens:array<struct<id:int,content:string>>>"
    rows = tokenizers.select(F.explode(F.from_json(F.col(text_col), kind)["added_tokens"]).alias("t"))
    found = rows.select("t.content", "t.id").filter(F.col("content").isin(codes))
    asked = tokenizers.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("content"))
    missing = F.raise_error(F.concat(F.lit("no language code "), F.col("content"))).cast("int")
    return asked.join(found, "content", "left").select("content", F.coalesce("id", missing).alias("id"))
