"""Column expressions (all native, no Python UDF)."""

from wardflow.functions.scalar import (  # noqa: F401
    apply_threshold,
    elapsed_hhmm,
    gender_code,
    lehmer,
    mask_sentinel,
    one_hot,
    risk_band,
    safe_float,
    to_minutes,
)
