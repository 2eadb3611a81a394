"""Column-level helpers (labels, hashing keys, scalar functions F1-F11)."""

from .columns import (  # noqa: F401
    BCE_EPSILON, bce_to, binarize, clipped_bce, every_second_if_double, format_setting,
    greater, l2_distance, l2_norm, label, md5_key, md5_uniform, pair_step, parse_list,
    path_join, round_even, safe_pred, suffix_int, title_setting, zip_explode,
)
