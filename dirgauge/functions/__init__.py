"""Pure Column functions."""

from dirgauge.functions.formats import (
    GB,
    KB,
    MB,
    SIZE_UNITS,
    TB,
    file_line,
    fmt_bytes,
    fmt_bytes_tb,
    fmt_count,
    fmt_mtime,
    gigabytes,
    quarter_label,
    report_line,
    size_in_unit,
)
from dirgauge.functions.paths import (
    base_name,
    file_name,
    last_segment,
    normal_path,
    parent_path,
    path_order,
)
from dirgauge.functions.stat import device_id, stat_time
