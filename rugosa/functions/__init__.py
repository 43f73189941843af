from rugosa.functions.features import (
    BASE_INPUTS,
    FEATURES_12,
    FEATURES_15,
    add_engineered_features,
    feature_matrix,
    poly_terms,
    poly_expand,
)
from rugosa.functions.scaling import (
    yeo_johnson,
    yeo_johnson_inverse,
    yj_loglik_columns,
)

__all__ = [
    "BASE_INPUTS",
    "FEATURES_12",
    "FEATURES_15",
    "add_engineered_features",
    "feature_matrix",
    "poly_terms",
    "poly_expand",
    "yeo_johnson",
    "yeo_johnson_inverse",
    "yj_loglik_columns",
]
