from starloom.functions.scalars import (  # noqa: F401
    as_column,
    bin_index,
    box_fraction,
    linear_relation,
    log10_positive,
    merit,
    missing_flag,
    percent,
    quantise,
    scale_factor,
    setup_redshift,
    setup_softening,
    snapshot_number,
    stable_hash,
)
