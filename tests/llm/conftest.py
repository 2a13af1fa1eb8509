import os
import sys

# the stages' brute-force versions live in the neighbouring test modules
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
