"""Calibration of raw confidences by type."""

from __future__ import annotations

# Raw -> calibrated breakpoints by type; between them it is linear.
RAW_POINTS = (0.5, 0.7, 0.85, 0.95)
CURVES = {
    "EMAIL": (0.45, 0.70, 0.90, 0.98),
    "SSN": (0.50, 0.72, 0.90, 0.98),
    "CREDIT_CARD": (0.50, 0.72, 0.90, 0.99),
    "PHONE_US": (0.45, 0.68, 0.88, 0.97),
    "PHONE_INTL": (0.42, 0.65, 0.85, 0.95),
    "PERSON_NAME": (0.40, 0.60, 0.80, 0.93),
    "ORGANIZATION": (0.38, 0.58, 0.78, 0.92),
    "LOCATION": (0.40, 0.62, 0.80, 0.93),
    "MEDICAL_TERM": (0.35, 0.55, 0.75, 0.90),
}


def calibrated(confidence: str, type_: str) -> str:
    """SQL for the calibrated confidence; 0 stays 0 and unknown types are unchanged."""
    branches = []
    for name, values in CURVES.items():
        steps = [f"WHEN {confidence} <= {RAW_POINTS[0]}D THEN {values[0]}D"]
        for x0, x1, y0, y1 in zip(RAW_POINTS, RAW_POINTS[1:], values, values[1:]):
            steps.append(
                f"WHEN {confidence} <= {x1}D THEN {y0}D + ({confidence} - {x0}D) "
                f"/ ({x1}D - {x0}D) * ({y1}D - {y0}D)"
            )
        branches.append(
            f"WHEN '{name}' THEN CASE {' '.join(steps)} ELSE {values[-1]}D END"
        )
    curve = f"CASE {type_} {' '.join(branches)} ELSE {confidence} END"
    return f"if({confidence} = 0, 0D, least(1D, greatest(0D, {curve})))"
