"""PySpark jobs that scan source code, configuration and dependencies of many repositories at once."""
