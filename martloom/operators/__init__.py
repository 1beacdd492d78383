"""Table operators. Data-dependent ones learn a small plan (`fit`) and apply it lazily."""
