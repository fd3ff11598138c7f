"""Queries over phrases in all their forms; the SQL has the results that are expected, written out, not the patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import lore
from foliant.functions import text as T
from foliant.operators import segment
from foliant.plans import ORACLES, QUERIES
from foliant.sources.corpus import table


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def phrases(name: str, result: Callable[[Column], Column], cases: list[tuple[str, str | None]]) -> None:
    """Registers a query that gives each row of the table part one of the phrases and what the function makes of it."""

    def run(s, d):
        said = F.element_at(F.array(*(F.lit(t) for t, _ in cases)), (F.col("p_partkey") % len(cases) + 1).cast("int"))
        return table(s, d, "part").select("p_partkey", said.alias("said")).select("p_partkey", result(F.col("said")).cast("string").alias("result"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT p_partkey, CAST(([{', '.join(_sql(w) for _, w in cases)}])[p_partkey % {len(cases)} + 1] AS VARCHAR) AS result FROM part"


def listed(array: Column) -> Column:
    return F.array_join(array, "|")


phrases("log_day_phrases", T.log_days, [
    ("Add 2 days to your LOG.", "2"), ("Add 2 days onto your LOG.", "2"), ("add 3 days into the log", None), ("Gain 1 day to LOG", "1"), ("Deduct 4 days from your\nLOG", "-4"),
    ("Lose 1 day LOG", "-1"), ("Subtract 2 days from your log and add 5 days to your log.", "3"), ("You have ten days in your LOG.", None), ("increase 6 days your LOGS", "6"), ("add two days to your LOG", None),
])

phrases("booty_phrases", lambda t: listed(T.booty(t)), [
    ("You gain 1 Gold Piece.", "gain 1 Gold Piece"), ("You find one slave and lose two slaves", "find one slave|lose two slaves"), ("Receive 20 gps", "Receive 20 gps"), ("spend 3\ngold\npieces now", "spend 3 gold pieces"),
    ("add 4 pieces of gold", "add 4 pieces of gold"), ("deduct one piece of  gold", "deduct one piece of gold"), ("gain six gold pieces", ""), ("gain 1 Gold Piece, gain 1 Gold Piece", "gain 1 Gold Piece"), ("Gold pieces gain", ""),
])

phrases("dice_phrases", lambda t: listed(T.dice_sentences(t)), [
    ("Roll two dice. If you can, go on.", "Roll two dice."), ("Hear a roll of thunder the orcs die.", ""), ("Now roll a die! Then roll the dice. Roll 3 dice? Roll one die.", "Now roll a die!|Then roll the dice.|Roll 3 dice?"),
    ("You must roll\ntwo dice here. Go.", "You must roll"), ("Roll one die. Roll one die. Wait.", "Roll one die."), ("You roll  three dice.", ""), ("A wall\nof stone: roll two   dice and roll one die", "of stone: roll two dice and roll one die"),
])

phrases("luck_phrases", T.luck_test, [("Test your Luck.", "true"), ("TEST\nYOUR  LUCK now", "true"), ("You test your lucky charm", "false"), ("contest your luck", "false"), ("Your luck is out", "false")])

phrases("stat_phrases", lambda t: listed(T.stat_changes(t)), [
    ("Lose 2 STAMINA points and lose 2 stamina points", "LOSE 2 STAMINA"), ("gain 1 point of Luck, deduct 3 points from SKILL", "GAIN 1 LUCK|DEDUCT 3 SKILL"), ("restore 4 points in crew\nstrength", "RESTORE 4 CREW STRENGTH"),
    ("increase 1 CREW  STRIKE; close 2 LUCK", "INCREASE 1 CREW STRIKE|LOSE 2 LUCK"), ("lose two STAMINA", ""), ("take 6 from your SKILL", ""),
])

phrases("turn_to_phrases", T.repair_turn_to, [
    ("turnto 12", "turn to 12"), ("If so, Turmn to 7.", "If so, turn to 7."), ("turm to 8", "turn to 8"), ("Tumn to9", "turn to 9"), ("tum to 123", "turn to 123"), ("furn to 5", "turn to 5"), ("fumto 44", "turn to 44"), ("lurn  to 6", "turn to 6"),
    ("hurmn to 1", "turn to 1"), ("turnin to 300", "turn to 300"), ("go on to 21", "go turn to 21"), ("return to 5", "return to 5"), ("turn to 5", "turn to 5"), ("tarn to 5", "tarn to 5"), ("tum lo 5", "tum lo 5"),
])

phrases("typed_commands", T.command, [
    ("go 12", "go"), ("please GO 12 now", "go"), (" 7 ", "go"), ("ergo 12", "unknown"), ("go home", "unknown"), ("newgame", "reset"), ("Restart it", "reset"), ("log out", "logout"), ("sever the pact", "logout"), ("quit", "unknown"), ("look at the map and save", "look"),
    ("Help", "help"), ("fight!", "battle"), ("I fight", "unknown"), ("strike him", "battle"), ("attacking", "unknown"), ("run", "flee"), ("rune", "unknown"), ("escape and save", "flee"), ("dice", "roll"), ("Roll 2d6", "roll"), ("please roll and save", "save"), ("my inventory", "inventory"), ("  ", None),
])

phrases("noise_phrases", T.is_noise_line, [
    ("12", "true"), ("Jo-32xyz", "true"), ("ABCDEFG", "true"), ("ÄÖÜÉÀÈÊ", "true"), ("Abcdefg", "false"), ("ÉCOLE ÉTÉ", "false"), ("-- .. == a b c --", "true"), ("The door opens.", "false"), ("où êtes-vous là", "false"), ("ABCDEFGHIJKLM", "false"), ("      wall      ", "true"),
])

phrases("plausible_phrases", T.is_plausible, [
    ("Élan et force dans la nuit noire,\nune porte s'ouvre au loin devant vous.", "true"), ("the door opens onto a long and dark corridor,\nwhich leads on and on without an end.", "false"), ("A short text\nof two lines.", "false"),
    ("The door opens onto a long and dark corridor, which leads on and on.", "false"), ("  The door opens onto a long and dark corridor,\n\nwhich leads on and on.", "true"),
])

phrases("prose_phrases", T.prose, [
    ("a long-\nword", "a longword"), ("a long- \n word", "a long word"), ("he went (in-\n)side", "he went (in)side"), ("one  \n two\n\n\nthree", "one two three"), ("well-known  thing", "well-known thing"), ("end -\r\nstop", "end stop"),
])

phrases("trim_phrases", lambda t: F.array_join(segment.trim_lines(F.split(t, "\n")), "\n"), [
    ("You may turn to\n14;", "You may turn to 14;"), ("Take the path (fum\no 130.", "Take the path (fum o 130."), ("Take the way. Tumn fo\nz7,", "Take the way. Tumn fo z7,"), ("You return to\n14", "You return to 14"), ("You may turn to\n14!", "You may turn to"),
    ("  \nA long way goes on.\n12\n*** ** *** **\nIt ends at a wall.\n3 -", "A long way goes on.\nIt ends at a wall."), ("12", ""),
])

phrases("raw_choice_phrases", lambda t: F.array_join(F.transform(T.raw_choices(t), lambda c: F.concat(c["target"].cast("string"), F.when(c["is_dice_roll"], "*").otherwise(""))), ","), [
    ("Turn to 7, or turn to the 12. Then go to 3.", "7,12"), ("Roll one die: turn to 5; else return to 5", "5*,5*"), ("Throw the DICE and turn to 4", "4*"), ("Stay here.", ""), ("turn  to 12345", "1234"),
])

phrases("combat_phrases", lambda t: F.concat_ws(",", T.has_combat(t), T.raw_combat(t), T.large_scale(t)), [
    ("ORC SKILLS 5 STAMINAS 6", "true,true,false"), ("ORC SKILL 5\nSTAMINA 6", "false,true,false"), ("SHIP STRIKE 5 STRENGTH 6", "true,false,true"), ("Strike with skill", "false,false,false"), ("UNSKILLED STAMINA", "true,true,false"),
])

phrases("end_phrases", lambda t: F.concat_ws(",", T.is_end(t), T.death(t), T.victory(t)), [
    ("Your adventure ends here.", "true,true,false"), ("You have won! You are king of the pirates.", "true,false,true"), ("You died, but triumph all the same.", "true,true,true"), ("You have died. Turn to 5.", "false,false,false"), ("Wait here.", "true,false,false"),
    ("[Text missing or unreadable in PDF]", "false,false,false"), ("The crown is yours. You succeed!", "true,false,true"), ("You succeed in opening it.", "true,false,false"), ("You meet your untimely end", "true,true,false"),
])

phrases("section_number_phrases", T.section_number, [("12", "12"), (" (400). ", "400"), ("401", None), ("0", None), ("12a", None), ("1 2", None), ("--7--", "7"), ("12345", None), ("", None)])

phrases("flee_phrases", lore.can_flee, [("You may escape by running.", "true"), ("There is no way out.", "false")])

phrases("note_phrases", lore.combat_note, [("They wait. Whenever you lose a\nround, run.", None), ("If you score a hit  on it, it dies. Roll one die.", "score a hit on it, it dies."), ("Roll one die to see.", "Roll one die to see."), ("Nothing.", None)])
