"""askwright.functions"""
