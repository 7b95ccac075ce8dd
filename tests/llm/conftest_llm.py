"""Builders that tests import by name."""

import importlib.util
import pathlib

_spec = importlib.util.spec_from_file_location("llm_conftest", pathlib.Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
make, prose, odd_rows = _module.make, _module.prose, _module.odd_rows
