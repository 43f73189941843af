"""Run settings as one frozen dataclass.

The values marked "fixed values" must equal the reference's for results to
line up; everything else is a Spark-side knob of our own.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # --- fixed values (reference constants) -------------------------------
    seed: int = 151101
    poly_degree: int = 2
    svr_trials: int = 60
    gpr_trials: int = 60
    ensemble_trials: int = 80
    n_splits: int = 5
    n_bins: int = 5
    guard_eps: float = 1e-9
    mape_floor: float = 1e-9
    ridge_alphas: tuple[float, ...] = (0.1, 1.0, 10.0)
    permutation_repeats: int = 10
    hist_bins: int = 15
    required_columns: tuple[str, ...] = ("Vc", "Fz", "ap", "Ra")
    # SVR defaults: C=1.5, epsilon=0.2, gamma="scale", degree 2
    svr_defaults: dict = field(
        default_factory=lambda: {"C": 1.5, "epsilon": 0.2, "gamma": "scale", "poly_degree": 2}
    )
    # GP defaults: amplitude=1, length_scale=1, alpha=1, noise=1e-4
    gpr_defaults: dict = field(
        default_factory=lambda: {"amplitude": 1.0, "length_scale": 1.0, "alpha": 1.0, "noise": 1e-4}
    )
    # search spaces: (low, high, log scale)
    svr_space: dict = field(
        default_factory=lambda: {
            "C": (0.1, 10.0, True),
            "epsilon": (0.01, 0.5, True),
            "gamma": (1e-3, 1.0, True),
            "poly_degree": (2, 4, False),
        }
    )
    gpr_space: dict = field(
        default_factory=lambda: {
            "amplitude": (1e-2, 5.0, True),
            "length_scale": (0.05, 3.0, True),
            "alpha": (1e-3, 5.0, True),
            "noise": (1e-6, 1e-2, True),
        }
    )
    gp_jitter: float = 1e-10

    # --- Spark-side knobs (ours) -------------------------------------------
    # hex digits of the md5 prefix used to split a rank into buckets; the
    # bucket-offset table has at most n_strata * 16**rank_bucket_hex rows.
    rank_bucket_hex: int = 3
    # landmarks of the GP
    gp_features: int = 256
    # for studies of many kernels at once (tuning, sensitivity)
    gp_tuning_features: int = 128
    # random Fourier features of the SVR
    svr_features: int = 64
    svr_huber_delta: float = 0.1
    yj_grid: tuple[float, float, int] = (-3.0, 5.0, 33)
    yj_refine_rounds: int = 2


SETTINGS = Settings()
