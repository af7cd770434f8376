from basketry.functions.windows import max_date, trailing_window, day_diff  # noqa: F401
from basketry.functions.order import hash_key, global_row_number, exact_percentile, top_k_list  # noqa: F401
