"""Table operators: profile, clean, describe, features, models, tuning, scoring."""
