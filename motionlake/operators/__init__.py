"""Motion operators: functions from DataFrame to DataFrame."""
