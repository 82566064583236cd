"""String patterns and Python functions of specifications."""
