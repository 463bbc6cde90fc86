import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent
for folder in (HERE.parent.parent, HERE.parent):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))
