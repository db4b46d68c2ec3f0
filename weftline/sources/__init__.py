"""Where statements come from and where results go."""
