"""Where inventories come from: raw listings and account files."""

from dirgauge.sources.accounts import load_accounts
from dirgauge.sources.listing import (
    classify,
    delta,
    delta_by_directory,
    error_counts,
    implied_directories,
    load_listing,
    load_roots,
    split_errors,
)
