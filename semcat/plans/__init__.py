"""Plans that put the operators together."""
