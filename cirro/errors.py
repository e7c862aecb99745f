"""Errors with short codes, and the registry of all codes."""

from __future__ import annotations

import warnings

#: Code and meaning of every condition the engine raises.
CODES = {
    "missing_column": "a table lacks a required column",
    "wrong_type": "a column has another type than the table requires",
    "unknown_variable": "a variable is not in the dictionary",
    "invalid_qc_flag": "a quality flag outside the closed set",
    "invalid_method": "a method outside the closed set",
    "invalid_tier": "a tier outside the closed set",
    "invalid_statistical_class": "a statistical class outside the closed set",
    "invalid_measurability_class": "a measurability class outside the closed set",
    "non_utc_time": "a time column is not a timestamp in UTC",
    "out_of_range": "an ok value outside its variable's range",
    "duplicate_key": "two rows of one key",
    "member_and_stat": "a forecast row has a member and a statistic",
    "bad_lead": "a lead that is not valid time less issue time",
    "lead_unresolved": "a lead is needed and null",
    "bad_units": "units that cannot be converted",
    "bad_mapping": "a mapping or a time it locates is unusable",
    "bad_site": "a site fails validation",
    "bad_instrument": "an instrument fails validation",
    "duplicate_site": "two sites share an id",
    "unknown_key": "a configuration key that is not known",
    "inline_secret": "a secret written out in a configuration",
    "missing_secret": "a secret is not in the environment",
    "secret_in_data": "a secret's value occurs in a table",
    "unknown_adapter": "a source kind without an adapter",
    "no_forecast_support": "the adapter has no forecasts",
    "no_forecast_aux_support": "the adapter has no text companions of forecasts",
    "mixed_source": "a fetch returned several sources",
    "unrequested_variable": "a fetch returned a variable that was not asked for",
    "unsupported_response": "a response the adapter cannot read",
    "unknown_silo_code": "a quality code without a meaning",
    "unresolved_station": "no station is resolved for the site",
    "no_geohash": "a search found no place",
    "http_gone": "the resource is gone",
    "http_client_error": "a request failed and is not worth a retry",
    "http_server_error": "a server failed after all retries",
    "no_network": "network access is switched off",
    "ladder_exhausted": "every rung of a transport ladder failed",
    "decoder_missing": "no decoder for binary grids is installed",
    "calib_not_found": "no calibration of that version",
    "tier_mismatch": "the stored calibration has another tier",
    "missing_roughness": "a wind correction without roughness length",
    "transfer_no_overlap": "no common times to fit a transfer on",
    "fill_missing_site": "a radiation fill without a site",
    "spatial_not_applicable": "a neighbour check of a variable that only models have",
    "unknown_table": "a table the store does not have",
    "bad_period": "a period such as '30 days' that cannot be read",
    "bad_mode": "a mode that does not exist",
    "single_site": "exactly one site is needed",
    "bad_provenance": "provenance that does not cover every value column",
    "bad_versions": "version keys are missing",
    "bad_ingest": "a table without the time column",
    "mixed_tier": "columns of several tiers",
    "tier_downgraded": "an operation lost or changed provenance",
    "content_changed": "a column's values differ from what was hashed",
    "carried_unit": "a value's own unit differs from the stated one",
}


class EngineError(Exception):
    """code is a key of CODES; context names what was wrong."""

    def __init__(self, code: str, message: str = "", **context):
        if code not in CODES:
            raise KeyError(code)
        self.code, self.context = code, context
        super().__init__(f"{code}: {message or CODES[code]}")


class EngineWarning(UserWarning):
    def __init__(self, code: str, message: str = ""):
        self.code = code
        super().__init__(f"{code}: {message or CODES[code]}")


def warn(code: str, message: str = "") -> None:
    warnings.warn(EngineWarning(code, message), stacklevel=3)
