"""Scans, schema, and persistence of processed results."""

from tenure.sources.readers import (  # noqa: F401
    load_activity, load_customer_profile, load_mixed, load_pricing, load_transactions,
    read_transactions, read_transactions_csv,
)
from tenure.sources.schema import KINDS, canonicalize, numeric_columns, validate  # noqa: F401
