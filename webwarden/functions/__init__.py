"""webwarden.functions"""
