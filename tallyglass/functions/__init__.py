from tallyglass.functions.columns import (  # noqa: F401
    clean,
    humanize,
    is_number_text,
    label_of,
    sample_kurtosis,
    sample_skewness,
    t_two_sided_p,
    title_words,
)
