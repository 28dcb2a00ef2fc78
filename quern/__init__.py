"""Quern: DataFrame operators for attributed, time-stamped statements."""
