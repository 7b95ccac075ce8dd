"""Plans of several passes: fitting, lenses, profiles."""
