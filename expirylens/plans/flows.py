"""End-to-end flows: tokens to predictions, accuracy reports, dataset expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame

from expirylens.functions.text import sanitize_tokens
from expirylens.operators import normalize as N, selection as S
from expirylens.operators.candidates import extract_candidates
from expirylens.plans.storage import materialise
from expirylens.schemas import as_tokens


def _extracted(tokens: DataFrame, params: S.ScoreParams, store) -> tuple[DataFrame, DataFrame]:
    t = as_tokens(tokens)
    if params.sanitization_mode != "none":
        t = as_tokens(sanitize_tokens(t, params.sanitization_mode))
    return t, extract_candidates(t, params.allow_day_first, params.allow_month_names, params.keep_invalid, materialise=store, by_text=True)


def scored_candidates(tokens: DataFrame, params: S.ScoreParams = S.ScoreParams(), store=materialise) -> DataFrame:
    """Extract once, store, then score from the stored table.

    Extraction is the expensive, narrow part; scoring reads it twice (image facts and candidates),
    each time only the columns it needs.
    """
    t, cands = _extracted(tokens, params, store)
    return S.score_candidates(S.features(cands, t, params), params)


def predict(tokens: DataFrame, images: DataFrame | None = None, selector: str = "keyword_regex",
            params: dict | S.ScoreParams | None = None, normalizer: str = "date_ko_v1",
            normalizer_params: dict | None = None, store=materialise) -> DataFrame:
    """One prediction per image. Selector and normalizer are picked by name."""
    select, params_type = S.selector(selector)
    normalize = N.normalizer(normalizer)
    if not isinstance(params, S.ScoreParams):
        params = S.with_overrides(params_type(), **(params or {}))
    t, cands = _extracted(tokens, params, store)
    scored = S.score_candidates(S.features(cands, t, params), params)
    args = (params, cands) if isinstance(params, S.UnionParams) and selector == "union_spatial" else ()
    return normalize(select(scored, images, *args), **(normalizer_params or {}))
